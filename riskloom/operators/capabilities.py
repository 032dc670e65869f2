"""What the code of a version can do: capabilities per file, their exposure classes, and what a manifest leaves out.

Patterns of a capability are one alternation; a file is scanned once per capability of its language, with literal
patterns and no join. Sets are folded per version with map-side combination.

Defined results: null contents have no capabilities; versions without any have no row; a null declaration declares
nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNER = ("ecosystem", "package", "version")

# Names and signatures by capability.
PYTHON = {
    "filesystem-read": r"\bos\.(?:scandir|listdir|walk)\b|\bglob\.i?glob\b",
    "filesystem-write": r"\bos\.(?:remove|unlink|rmdir|rename|replace|makedirs|mkdir|chmod|chown)\b|\bshutil\.(?:copy2?|copyfile|copytree|move|rmtree)\b",
    "shell": r"\bsubprocess\.(?:run|Popen|call|check_call|check_output|getoutput)\b|\bos\.(?:system|popen)\b|\bpty\.(?:spawn|fork)\b|\basyncio\.create_subprocess_(?:exec|shell)\b",
    "network": r"\brequests\.(?:get|post|put|patch|delete|head|request)\b|\bhttpx\.(?:get|post|put|AsyncClient)\b|\burllib\.request\.(?:urlopen|Request)\b|\baiohttp\.ClientSession\b|\bsocket\.(?:socket|create_connection)\b|\bhttp\.client\.HTTPS?Connection\b|\bwebsockets\.connect\b|\bsmtplib\.SMTP",
    "env-secrets": r"\bos\.(?:environ|getenv)\b|\bload_dotenv\b",
    "code-exec": r"(?:^|[^\w.])(?:exec|eval|compile|__import__)\s*\(|\bimportlib\.import_module\b|\bmarshal\.loads\b|\bpickle\.loads\b|\byaml\.load\b",
    "db-access": r"\b(?:psycopg2?|pymysql|duckdb|sqlite3|mysql\.connector)\.connect\b|\bsqlalchemy\.create_engine\b|\bredis\.(?:Strict)?Redis\b|\bpymongo\.MongoClient\b",
    "mcp-client": r"(?:from|import) mcp\.client",
    "mcp-server": r"(?:from|import) mcp\.server|\bFastMCP\b|@server\.(?:list_tools|call_tool)",
    "llm-call": r"(?:from|import) (?:openai|anthropic|cohere|mistralai|langchain)",
    "memory-persistent": r"from langchain\.memory|from llama_index\.core\.memory|chromadb\.Collection|pinecone\.Index",
    "agent-to-agent": r"from crewai|from autogen|\bGroupChat\b",
}
JAVASCRIPT = {
    "filesystem-read": r"\bfs\.(?:readFile|readdir)(?:Sync)?\b|\bfs\.createReadStream\b|\bfsPromises\.readFile\b",
    "filesystem-write": r"\bfs\.(?:writeFile|appendFile|unlink|rm(?:dir)?|rename|copyFile|mkdir|chmod)(?:Sync)?\b|\bfs\.createWriteStream\b",
    "shell": r"\bchild_process\.(?:exec(?:File)?|spawn)(?:Sync)?\b|\bchild_process\.fork\b|\bexeca\(|\bshelljs\.exec\b|\bBun\.spawn\b",
    "network": r"\bfetch\(|\baxios(?:\.(?:get|post|put|delete|patch|head)\b|\()|\bhttps?\.request\b|\bgot\(|\bnode-fetch\b|\bundici\.(?:fetch|request)\b|\bnet\.(?:Socket|createConnection)\b|\bnodemailer\.createTransport\b",
    "env-secrets": r"\bprocess\.env\b|\bdotenv\.config\(",
    "code-exec": r"\beval\(|\bnew\s+Function\(|\bvm\.runIn(?:NewContext|ThisContext|Context)\b|\bvm2\.NodeVM\b",
    "db-access": r"['\"](?:pg|mysql2?|mongodb|ioredis|@prisma/client)['\"]",
    "mcp-client": r"@modelcontextprotocol/sdk/client",
    "mcp-server": r"@modelcontextprotocol/sdk/server",
    "llm-call": r"['\"](?:openai|cohere-ai)['\"]|@anthropic-ai/sdk|@google/generative-ai|\b(?:generateText|streamText|generateObject)\(",
    "memory-persistent": r"@pinecone-database/pinecone|['\"]chromadb['\"]|@qdrant/js-client-rest",
}
CREDENTIAL_PATHS = r"~/\.(?:ssh|aws|gnupg|kube)/|~/\.config/gcloud/|~/\.docker/config\.json|~/\.netrc|\bid_(?:rsa|ed25519|ecdsa)\b|credentials\.json|service[-_]account[-_]?key"
# Exposure classes: A untrusted input, B private data, C outside effects.
CLASSES = {
    "filesystem-read": "AB", "filesystem-write": "C", "shell": "C", "network": "AC", "env-secrets": "B", "code-exec": "C", "credential-paths": "B",
    "db-access": "ABC", "mcp-client": "AC", "mcp-server": "AC", "llm-call": "A", "memory-persistent": "BC", "agent-to-agent": "AC",
}
DANGEROUS = ("shell", "code-exec", "credential-paths")
MEDIUM = ("network", "filesystem-write", "env-secrets", "db-access", "mcp-server")


def file_capabilities(files: DataFrame) -> DataFrame:
    """(file_id, ecosystem, package, version, capability)."""
    language, content = F.lower(F.trim("language")), F.col("content")

    def flags(table: dict[str, str]) -> Column:
        table = table | {"credential-paths": CREDENTIAL_PATHS}
        return F.array_compact(F.array(*[F.when(content.rlike(p), F.lit(name)) for name, p in table.items()]))

    rows = files.where(language.isin("python", "javascript") & content.isNotNull()).dropDuplicates(["file_id"])
    found = F.when(language == "python", flags(PYTHON)).otherwise(flags(JAVASCRIPT))
    return rows.select("file_id", *OWNER, F.explode(found).alias("capability"))


def exposure(capabilities: DataFrame) -> DataFrame:
    """(…, capabilities, classes, trifecta) per version; trifecta: all three classes at once."""
    classes = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    g = capabilities.groupBy(*OWNER).agg(F.array_sort(F.collect_set("capability")).alias("c"))
    letters = F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda x: F.filter(F.split(classes[x], ""), lambda y: y != "")))))
    joined = F.array_join(letters, "")
    return g.select(*OWNER, F.array_join("c", ",").alias("capabilities"), joined.alias("classes"), (joined == "ABC").alias("trifecta"))


def undeclared(capabilities: DataFrame, declared: DataFrame) -> DataFrame:
    """(…, capability, severity) that declared (…, capability) lacks."""
    found = capabilities.select(*OWNER, "capability").distinct().join(declared.select(*OWNER, "capability").distinct(), [*OWNER, "capability"], "left_anti")
    severity = F.when(F.col("capability").isin(*DANGEROUS), "HIGH").when(F.col("capability").isin(*MEDIUM), "MEDIUM").otherwise("LOW")
    return found.withColumn("severity", severity)
