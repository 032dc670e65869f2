"""Packages that drive language models: how surely a version is one, which of its files break a rule, and the verdict.

Every test is a literal pattern in one projection over the files; flags are folded per version with map-side combination,
so no file is gathered anywhere. A version is taken for an agent if it declares itself one or its signals weigh enough.

Defined results: null contents match nothing; versions without files have no signals from files; a null declaration
declares nothing; versions that are no agents are CLEAN here, as other stages judge them; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.capabilities import DANGEROUS, undeclared

OWNER = ("ecosystem", "package", "version")
#: Weight that makes a version an agent.
THRESHOLD = 5

# Names of packages, words of descriptions, dependencies.
NAME = {
    "PyPI": r"(?:^|[-_])(?:agent|autogpt|crewai|langchain|langgraph|llama[-_]?index|autogen|haystack)(?:[-_]|$)|^mcp-",
    "npm": r"(?:^|[-/])(?:agent|langchain|llamaindex|crewai|autogen)|^@modelcontextprotocol/|^mcp-server-|-agent$",
}
DESCRIPTION = (
    "ai agent", "llm agent", "autonomous agent", "tool use", "tool calling", "function calling", "mcp", "model context protocol", "agentic", "react",
    "agent loop",
)
MODEL_CLIENTS = (
    "openai", "anthropic", "google-generativeai", "cohere", "mistralai", "boto3", "@anthropic-ai/sdk", "@google/generative-ai", "cohere-ai",
    "@aws-sdk/client-bedrock-runtime",
)
FRAMEWORKS = (
    "langchain", "langchain-core", "langgraph", "llama-index", "llama-index-core", "crewai", "autogen-agentchat", "autogen", "haystack-ai", "mcp",
    "openai-agents", "@langchain/core", "@langchain/langgraph", "@langchain/openai", "@langchain/anthropic", "llamaindex", "@llamaindex/core",
    "@modelcontextprotocol/sdk", "ai",
)
STORES = (
    "chromadb", "pinecone", "weaviate", "faiss", "qdrant-client", "qdrant_client", "pinecone-client", "@pinecone-database/pinecone", "weaviate-client",
    "@qdrant/js-client-rest",
)
# Signs of agents in contents, with their weight.
SIGNS = {
    "server": (3, r"from mcp\.server|@server\.(?:list_tools|call_tool)|@modelcontextprotocol/sdk/server|setRequestHandler\s*\(\s*ListToolsRequestSchema"),
    "tool": (2, r"@tool\b|@function_tool\b|@server\.call_tool|\bDynamicTool\b|\bdefineFunction\b"),
    "schema": (2, r"[\"']type[\"']\s*:\s*[\"']function[\"']|\btool_choice\b|\bfunction_call\b"),
    "classes": (2, r"import\s+[^\n]*\b(?:AgentExecutor|Agent|ToolExecutor)\b"),
    "memory": (1, r"langchain\.memory|llama_index\.core\.memory"),
}
STEPS = (r"(?i)\bThought:\s", r"(?i)\bAction:\s", r"(?i)\bObservation:\s")
MODEL_CALL = r"(?:openai\.|anthropic\.|llm\.|model\.)(?:invoke|chat\s*\.\s*completions|messages\s*\.\s*create|generate_content|complete|chat)"
DISPATCH = r"tool\s*\.\s*(?:invoke|run)|tools\[.*?\]|globals\(\)\[.*?\]|getattr\(.*?,\s*tool_name\)"
LOOP = r"(?m)^\s*(?:while|for)\b"
APPROVAL = (
    r"\binput\s*\(\s*[\"'][^\"']*\?[^\"']*[\"']\s*\)|\bconfirm\s*\(|\bapproval_required\s*=\s*True|\bhuman_in_the_loop\b|\b[hH]umanInTheLoop\b"
    r"|\brequest_approval\b|@requires_approval\b|\bask_user_to_continue\b|\breadlineSync\b|\binquirer\b|\bprompts\s*\(|\brequireApproval\b"
)
# Rules over contents: severity, severity where a declared design excuses it, those designs, pattern.
RULES = {
    "R1-1": (
        "HIGH_RISK", "SUSPICIOUS", ("dual-llm", "llm-map-reduce"),
        r"(?i)(?:system|prompt|instruction)\s*=\s*f[\"'][^\"']*\{[^}]*(?:html|content|data|text|page|fetched|scraped|web|response|tool_output|observation|external|user_input|search_result|retrieved)[^}]*\}"
        r"|\{[\"']role[\"']\s*:\s*[\"']system[\"']\s*,\s*[\"']content[\"']\s*:\s*[^}]*(?:\+\s*\w+|f[\"'][^\"']*\{)"
        r"|messages\s*\.\s*append\s*\(\s*\{\s*[\"']role[\"']\s*:\s*[\"']system[\"'][\s\S]{0,80}tool",
    ),
    "R1-2": (
        "HIGH_RISK", "HIGH_RISK", (),
        r"(?i)requests\.get\s*\([^)]*\)\s*\.json\(\)|agent\s*\.\s*bind_tools\s*\([^)]*remote|tools?\s*\.\s*append\s*\(\s*request|client\.listTools\s*\(|session\.list_tools\s*\(",
    ),
    "R1-3": (
        "SUSPICIOUS", "SUSPICIOUS", ("plan-then-execute", "context-minimization"),
        r"(?i)(?:web_search|search|browse|fetch|crawl|scrape)\s*\([^)]*\)[\s\S]{0,200}(?:llm|model|chain|agent)\s*\.\s*invoke"
        r"|(results?|content|response|page|html)\s*=\s*(?:requests|httpx|fetch)\s*\.[\s\S]{0,300}messages\s*\.\s*append\s*\([^)]*\1",
    ),
    "R1-4": (
        "HIGH_RISK", "SUSPICIOUS", ("action-selector", "code-then-execute"),
        r"(?i)(code|cmd|tool_call|llm_output|generated)\s*=\s*(?:llm|model|client)\s*\.\s*(?:invoke|complete|chat|generate)[\s\S]{0,200}(?:exec|eval)\s*\(\s*\1"
        r"|subprocess\.\w+\s*\([^)]*shell\s*=\s*True[^)]*(?:llm_|model_|generated_|cmd|command)|globals\(\)\s*\[\s*\w+\s*\]\s*\(|getattr\s*\([^,]+,\s*\w+\s*\)\s*\(",
    ),
    "R2-2": ("MALICIOUS", "MALICIOUS", (), r"\bos\.set[ug]id\s*\(\s*0\s*\)|subprocess\.\w+\s*\(\s*\[\s*[\"']sudo[\"']|setresuid\s*\(\s*0\s*,\s*0\s*,\s*0\s*\)|capset\s*\("),
    "R2-3": (
        "MALICIOUS", "MALICIOUS", (),
        r"[\"']/var/run/docker\.sock[\"']|[\"']/proc/self/cgroup[\"']|\bos\.unshare\s*\(|CLONE_NEW(?:NS|UTS|PID|NET|USER)|\bos\.listdir\s*\(\s*[\"']/proc[\"']\s*\)",
    ),
    "R2-4": (
        "HIGH_RISK", "HIGH_RISK", (),
        r"subprocess\.\w+\s*\(\s*\[\s*[\"']pip[\"']\s*,\s*[\"']install[\"']|os\.system\s*\(\s*f?[\"'][^\"']*pip\s+install|__import__\s*\(\s*[\"']pip[\"']\s*\)\s*\.\s*main|child_process\.exec\s*\([^)]*npm\s+install",
    ),
}
#: A dependency that a model chooses at run time.
CHOSEN = r"(?i)(?:subprocess\.\w+|os\.system|child_process\.exec)\s*\([^)]*(?:llm_|model_|agent_|generated_)"


def signals(packages: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(…, score, is_agent, has_approval) of packages (…, description), from their names, files and dependencies (…, name)."""
    content = F.coalesce("content", F.lit(""))
    steps = sum((content.rlike(p).cast("int") for p in STEPS), F.lit(0))
    flags = {name: content.rlike(p) for name, (_, p) in SIGNS.items()}
    flags |= {"steps": steps >= 2, "loop": content.rlike(MODEL_CALL) & content.rlike(DISPATCH) & content.rlike(LOOP), "approval": content.rlike(APPROVAL)}
    by_file = files.select(*OWNER, *[f.alias(f"_{n}") for n, f in flags.items()]).groupBy(*OWNER).agg(*[F.max(f"_{n}").alias(f"_{n}") for n in flags])
    name = F.lower("name")
    kinds = {"client": MODEL_CLIENTS, "framework": FRAMEWORKS, "store": STORES}
    by_dependency = dependencies.groupBy(*OWNER).agg(*[F.max(name.isin(*v)).alias(f"_{k}") for k, v in kinds.items()])
    j = packages.join(by_file, list(OWNER), "left").join(by_dependency, list(OWNER), "left")
    low, described = F.lower("package"), F.lit(False)
    for word in DESCRIPTION:
        described = described | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(word))
    named = F.when(F.col("ecosystem") == "PyPI", low.rlike(NAME["PyPI"])).otherwise(low.rlike(NAME["npm"]))
    weighed = [(3, named), (3, described), (3, F.col("_steps")), (3, F.col("_loop")), (2, F.col("_client")), (2, F.col("_framework")), (1, F.col("_store"))]
    weighed += [(w, F.col(f"_{n}")) for n, (w, _) in SIGNS.items()]
    score = F.lit(0)
    for weight, flag in weighed:
        score = score + F.when(flag, weight).otherwise(0)
    return j.select(*OWNER, score.alias("score"), (score >= THRESHOLD).alias("is_agent"), F.coalesce("_approval", F.lit(False)).alias("has_approval"))


def rule_hits(files: DataFrame, designs: DataFrame | None = None) -> DataFrame:
    """(…, path, rule, severity): files that break a rule; designs (…, design) are what versions declare to have applied."""
    content = F.coalesce("content", F.lit(""))
    rows = files.withColumn("_d", F.array().cast("array<string>"))
    if designs is not None:
        rows = files.join(designs.groupBy(*OWNER).agg(F.collect_set("design").alias("_d")), list(OWNER), "left")

    def severity(rule: str) -> Column:
        plain, excused, by, _ = RULES[rule]
        if rule == "R2-4":
            return F.when(content.rlike(CHOSEN), "MALICIOUS").otherwise(plain)
        if not by:
            return F.lit(plain)
        return F.when(F.arrays_overlap(F.coalesce("_d", F.array().cast("array<string>")), F.array(*map(F.lit, by))), excused).otherwise(plain)

    hits = [F.when(content.rlike(RULES[r][3]), F.struct(F.lit(r).alias("rule"), severity(r).alias("severity"))) for r in RULES]
    found = rows.select(*OWNER, "path", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return found.select(*OWNER, "path", "h.rule", "h.severity")


def classified(found: DataFrame, hits: DataFrame, capabilities: DataFrame, exposure: DataFrame, declared: DataFrame) -> DataFrame:
    """(…, is_agent, verdict, reason) of found (…, score, is_agent, has_approval): undeclared dangerous capabilities are
    MALICIOUS; then the gravest rule decides, the union of all three exposures without approval counting as a HIGH_RISK
    rule and two or more rules on prompts as another; an agent without any is AGENTIC. declared: (…, capability), of
    versions that declare themselves agents."""
    said = declared.select(*OWNER).distinct().withColumn("_said", F.lit(True))
    missing = undeclared(capabilities, declared).groupBy(*OWNER).agg(F.max(F.col("capability").isin(*DANGEROUS)).alias("_dangerous"))
    grave = {"MALICIOUS": 3, "HIGH_RISK": 2, "SUSPICIOUS": 1}
    rank = F.lit(0)
    for level, n in grave.items():
        rank = F.when(F.col("severity") == level, n).otherwise(rank)
    per = hits.groupBy(*OWNER).agg(F.max(rank).alias("_rank"), F.count_if(F.startswith("rule", F.lit("R1-"))).alias("_prompts"), F.array_sort(F.collect_set("rule")).alias("_rules"))
    j = found.join(said, list(OWNER), "left").join(missing, list(OWNER), "left").join(per, list(OWNER), "left")
    j = j.join(exposure.select(*OWNER, "trifecta"), list(OWNER), "left")
    agent = F.col("is_agent") | F.coalesce("_said", F.lit(False))
    three = F.coalesce("trifecta", F.lit(False))
    most = F.greatest(
        F.coalesce("_rank", F.lit(0)), F.when(three & ~F.col("has_approval"), 2).when(three, 1).otherwise(0), F.when(F.col("_prompts") >= 2, 2).otherwise(0)
    )
    dangerous = F.coalesce("_dangerous", F.lit(False))
    verdict = (
        F.when(~agent, "CLEAN").when(dangerous, "MALICIOUS").when(most == 3, "MALICIOUS").when(most == 2, "HIGH_RISK").when(most == 1, "SUSPICIOUS").otherwise("AGENTIC")
    )
    rules = F.array_join(F.concat(F.coalesce("_rules", F.array().cast("array<string>")), F.when(three, F.array(F.lit("R2-1"))).otherwise(F.array().cast("array<string>"))), ",")
    reason = F.when(~agent, "no agent").when(dangerous, "undeclared capability").when(most > 0, rules).otherwise("declared or no rule broken")
    return j.select(*OWNER, agent.alias("is_agent"), verdict.alias("verdict"), reason.alias("reason"))
