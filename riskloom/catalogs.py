"""Names, patterns and limits that results depend on. Small tables, always sent along with a plan."""

from __future__ import annotations

# Attack dimensions as one letter each: I information reading, E encoding, X payload execution, T data transmission.
# Calls by language and dimension.
PYTHON_CALLS = {
    "I": (
        "os.environ.get", "os.environ.__getitem__", "os.getenv", "os.uname", "platform.uname", "platform.system", "platform.node",
        "platform.machine", "platform.platform", "getpass.getuser", "socket.gethostname", "socket.gethostbyname", "pathlib.Path.home",
        "os.path.expanduser",
    ),
    "E": (
        "base64.b64decode", "base64.b64encode", "base64.b32decode", "base64.a85decode", "base64.urlsafe_b64decode", "codecs.decode",
        "codecs.encode", "zlib.decompress", "zlib.compress", "gzip.decompress", "bz2.decompress", "bytes.fromhex",
    ),
    "X": (
        "marshal.loads", "pickle.loads", "exec", "eval", "__import__", "importlib.import_module", "subprocess.run", "subprocess.Popen",
        "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.getoutput", "os.system", "os.popen", "os.execv",
        "os.execvp", "os.execve", "os.spawnv", "os.fork", "pty.spawn", "ctypes.CDLL", "ctypes.windll",
    ),
    "T": (
        "requests.get", "requests.post", "requests.put", "requests.patch", "requests.request", "urllib.request.urlopen",
        "urllib.request.Request", "urllib.request.urlretrieve", "urllib.urlopen", "http.client.HTTPConnection",
        "http.client.HTTPSConnection", "httpx.get", "httpx.post", "aiohttp.ClientSession", "socket.socket", "socket.create_connection",
        "ftplib.FTP", "smtplib.SMTP", "telnetlib.Telnet",
    ),
}
JAVASCRIPT_CALLS = {
    "I": (
        "process.env", "os.userInfo", "os.hostname", "os.homedir", "os.tmpdir", "os.platform", "os.arch", "os.networkInterfaces",
        "fs.readFileSync", "fs.readFile", "fs.readdirSync", "fs.readdir", "fs.statSync",
    ),
    "E": (
        "Buffer.from", "atob", "btoa", "zlib.gunzipSync", "zlib.inflateSync", "zlib.brotliDecompressSync",
    ),
    "X": (
        "eval", "Function", "child_process.exec", "child_process.execSync", "child_process.spawn", "child_process.spawnSync",
        "child_process.execFile", "child_process.execFileSync", "child_process.fork", "vm.runInNewContext", "vm.runInThisContext",
        "vm.Script", "require",
    ),
    "T": (
        "http.request", "https.request", "http.get", "https.get", "fetch", "axios.get", "axios.post", "net.Socket", "net.createConnection",
        "dgram.createSocket", "dns.lookup", "dns.resolve", "WebSocket",
    ),
}

# Sequence patterns over dimension letters, with severity.
SEQUENCES = [
    ("SP-001", "HIGH", "I{1,5}E{0,3}T{1,2}"),
    ("SP-002", "HIGH", "T{1,2}X{1,2}"),
    ("SP-003", "HIGH", "E{1,3}X{1,2}"),
    ("SP-004", "MEDIUM", "I{2,10}T{1,2}"),
    ("SP-005", "MEDIUM", "I{1,3}X{1,2}"),
    ("SP-006", "HIGH", "I{1,10}E{1,5}X{1,3}T{1,3}"),
]

# Behaviour rules, the dimensions a file must show.
BEHAVIOR_RULES = [
    ("T1552.001", "IT", "HIGH"),
    ("T1048.003", "IET", "HIGH"),
    ("T1027", "EX", "HIGH"),
    ("T1105", "XT", "HIGH"),
    ("T1059", "X", "MEDIUM"),
]

# Line patterns (code, confidence, pattern). What a look-behind for "no word character or dot before" would
# say is written as (?:^|[^\w.]), so that engines without look-around read them too.
LINE_PATTERNS = [
    ("EXS-003", 0.85, r"cmdclass\s*=\s*\{[^}]*['\"](?:install|develop|build_py|egg_info)['\"]"),
    ("EXM-002", 0.4, r"if\s+(?:platform|sys)\.platform\s*[=!]="),
    ("EXM-002", 0.6, r"if\s+platform\.system\s*\(\s*\)\s*[=!]=\s*['\"]"),
    ("EXM-002", 0.5, r"if\s+datetime\.(?:datetime\.)?(?:now|today|utcnow)\s*\(\s*\)\s*[<>]"),
    ("EXM-003", 0.7, r"ctypes\.(?:CDLL|WinDLL|windll)"),
    ("EXM-003", 0.9, r"ctypes\.CFUNCTYPE\s*\([^)]*\)\s*\(\s*ctypes\.addressof"),
    ("EXM-003", 0.85, r"ctypes\.(?:CFUNCTYPE|cast)\s*\([^)]*\)\s*\([^)]*create_string_buffer"),
    ("EXM-004", 0.8, r"creationflags\s*=\s*[A-Z_|0-9]*DETACHED"),
    ("EXM-007", 0.8, r"subprocess\.(?:run|Popen|call)\s*\(\s*\[?[\"']?(?:bash|sh|powershell)['\"]?"),
    ("EXF-003", 0.7, r"socket\.gethostbyname\s*\(\s*\w*\+"),
    ("EXF-003", 0.85, r"socket\.gethostbyname\s*\(\s*f[\"'][^\"']*\{[^}]+\}[^\"']*\.[a-z]"),
    ("EXF-003", 0.6, r"socket\.gethostbyname\s*\(\s*[\"'][^\"']*\{"),
    ("EXF-004", 0.95, r"discord\.com/api/webhooks/|hooks\.slack\.com/services/|api\.telegram\.org/bot"),
    ("EXF-005", 0.85, r"https?://(?:[\w.-]+\.)?(?:pastebin\.com|transfer\.sh|paste\.ee|0x0\.st|file\.io)"),
    ("EXF-005", 0.95, r"\.onion(?:/|\b)"),
    ("SYS-001", 0.85, r"os\.environ\s*\[\s*['\"](?:PATH|LD_PRELOAD|LD_LIBRARY_PATH|PYTHONPATH)['\"]\s*\]\s*="),
    ("SYS-002", 0.85, r"\.(?:bashrc|zshrc|profile|bash_profile)|HKEY_(?:CURRENT_USER|LOCAL_MACHINE)\\Software\\Microsoft\\Windows\\CurrentVersion\\Run|crontab\s+-"),
    ("SYS-003", 0.95, r"\b(?:wallet\.dat|keystore|MetaMask|\.electrum|Exodus|Atomic Wallet)\b"),
    ("SYS-004", 0.6, r"os\.walk\s*\(\s*['\"]?(?:/|~|\$HOME|C:\\\\)"),
    ("SYS-007", 0.85, r"shutil\.rmtree\s*\(\s*['\"]?(?:/|~|\$HOME|C:\\\\)"),
    ("SYS-007", 0.85, r"shutil\.rmtree\s*\(\s*os\.path\.expanduser\s*\(\s*['\"]~"),
    ("SYS-007", 0.85, r"shutil\.rmtree\s*\(\s*Path\.home\s*\(\s*\)"),
    ("SYS-009", 0.85, r"open\s*\(\s*['\"](?:/etc/|/usr/bin/|/usr/local/bin/|C:\\\\Windows\\\\System32)"),
    (
        "SYS-003", 0.9,
        r"(?:fs\.readFile(?:Sync)?|open|read_text|loadFile|readFile)\s*\(\s*['\"](?:"
        r"/etc/(?:passwd|shadow|sudoers|gshadow|hosts|hostname|resolv\.conf|crontab|ssh/[^'\"]+|systemd/[^'\"]+|cron\.d/)"
        r"|~/\.(?:ssh|aws|gcp|gnupg|netrc|docker|npmrc|pypirc|kube)|\$HOME/\.(?:ssh|aws|gcp|gnupg|netrc)"
        r"|%(?:USERPROFILE|APPDATA|LOCALAPPDATA)%\\\\[^'\"]*(?:credentials|cookies|login)|C:\\\\Users\\\\[^'\"]*\\\\\.(?:ssh|aws)"
        r"|/proc/(?:self/environ|self/cmdline|version)|/var/log/auth|/var/log/secure)",
    ),
    ("NET-001", 0.7, r"\b(?:ipinfo\.io|ip-api\.com|ipify\.org|ifconfig\.me|ipgeolocation)\b"),
    ("SYS-005", 0.85, r"from\s+pynput\s+import\s+keyboard|pynput\.keyboard\.Listener"),
    ("SYS-005", 0.85, r"\bkeyboard\.on_press\b|\bkeyboard\.read_event\b|\bkeyboard\.hook\b"),
    ("SYS-005", 0.95, r"\b(?:CallNextHookEx|SetWindowsHookEx|WH_KEYBOARD_LL)\b"),
    ("SYS-005", 0.7, r"\b(?:pyperclip|win32clipboard|pyclip)\b.*\bpaste\b"),
    ("NET-002", 0.95, r"stratum\+tcp://|(?:minexmr|supportxmr|pool\.minexmr)\.com"),
    ("NET-007", 0.95, r"curl\s+[^|;]*\|\s*(?:bash|sh|python|node)|wget\s+[^|;]*\|\s*(?:bash|sh)"),
    ("NET-008", 0.9, r"(?:/dev/tcp/|os\.dup2\([^)]+,\s*[012]\))"),
    ("DEF-005", 0.7, r"(?:^|[^\w.])(?:exec|Function)\s*\(\s*[a-zA-Z_]\w*\s*\)"),
    ("DEF-005", 0.85, r"(?:^|[^\w.])exec\s*\(\s*(?:base64|codecs|bytes|zlib|gzip)\.[a-z_0-9]+\("),
    ("DEF-005", 0.85, r"(?:^|[^\w.])eval\s*\(\s*(?:base64|codecs|bytes|zlib|gzip)\.[a-z_0-9]+\("),
    ("DEF-005", 0.95, r"(?:^|[^\w.])(?:exec|eval)\s*\(\s*\w+\s*\(\s*['\"]https?://[^'\"]+['\"]\s*\)\s*\.\s*read\s*\(\s*\)\s*\)"),
    ("DEF-005", 0.93, r"(?:^|[^\w.])(?:exec|eval)\s*\(\s*\w+\s*\(\s*['\"]https?://[^'\"]+['\"][^)]*\)\s*\.read\s*\(\s*\)"),
    ("NET-009", 0.8, r"verify\s*=\s*False|_create_unverified_context|rejectUnauthorized\s*[:=]\s*false"),
    ("DEF-006", 0.4, r"except\s*(?:[A-Za-z]+\s*)?:\s*pass|2>/dev/null|stderr\s*=\s*subprocess\.DEVNULL"),
    ("EXM-005", 0.85, r"\b\w+\s*=\s*__import__\s*\(\s*[\"'](?:os|subprocess|sys|importlib|socket|urllib|ctypes|pty|shutil|pickle|marshal)[\"']\s*\)"),
    ("EXM-005", 0.85, r"\b\w+\s*=\s*importlib\.import_module\s*\(\s*[\"'](?:os|subprocess|sys|socket|ctypes|pty)[\"']"),
    ("EXM-001", 0.8, r"\.write\s*\(\s*[bf]?[\"'][^\"']*\b(?:exec|eval|subprocess\.run|os\.system|importlib\.import_module)\s*\("),
]

# Patterns over whole files (code, confidence, pattern).
FILE_PATTERNS = [
    ("EXM-006", 0.6, r"while\s+(?:True|1)\s*:[\s\S]{0,200}(?:sys\.stdout\.write|print)\s*\("),
    ("EXM-006", 0.65, r"while\s+(?:True|1)\s*:[\s\S]{0,300}open\s*\([^)]*[\"']w[\"']?\s*\)\s*\.write"),
    ("EXF-001", 0.85, r"(?:os\.environ\.items\s*\(\s*\)|dict\s*\(\s*os\.environ\s*\)|for\s+\w+(?:\s*,\s*\w+)?\s+in\s+os\.environ)[\s\S]{0,400}(?:requests\.|urllib\.request\.urlopen|httpx\.|aiohttp\.)"),
    ("EXM-006", 0.7, r"(_orig\w*|_original\w*)\s*=\s*\w+\.\w+\.\w+[\s\S]{0,400}\1\s*\("),
    ("EXM-006", 0.85, r"\bparamiko\.\w+\.(?:connect|exec_command|invoke_shell)\s*=\s*\w"),
    ("EXM-006", 0.85, r"\brequests\.(?:get|post|put|delete|Session|request)\s*=\s*\w"),
    ("EXM-006", 0.7, r"\b(?:urllib|httpx|http\.client)\.\w+\s*=\s*\w"),
    ("DOW-001", 0.88, r"(?:requests\.(?:get|post)|urllib\.request\.urlopen|httpx\.get)\s*\([^)]+\)[\s\S]{0,300}?(?<![\w.])(?:exec|eval|compile)\s*\("),
    ("DOW-001", 0.88, r"(?:fetch|axios\.(?:get|post))\s*\([^)]+\)[\s\S]{0,400}?(?:\beval\s*\(|new\s+Function\s*\(|child_process\.exec\s*\()"),
    ("DOW-001", 0.85, r"(?:requests\.(?:get|post)|urllib\.request\.urlopen)[\s\S]{0,200}?\.(?:text|read|json|content)[\s\S]{0,100}?(?:subprocess\.(?:run|Popen|call|check_output)|os\.system|os\.popen)"),
    (
        "DOW-002", 0.92,
        r"(?:requests\.(?:get|post)|urllib\.request\.urlopen)[\s\S]{0,200}?open\s*\([^)]*[\"']wb?[\"'][^)]*\)\s*\.write\s*\([\s\S]{0,200}?"
        r"(?:subprocess\.(?:run|Popen|call)|os\.system|os\.popen|os\.execv)",
    ),
    ("DOW-002", 0.92, r"(?:fetch|axios)[\s\S]{0,200}?fs\.(?:writeFile|writeFileSync)[\s\S]{0,200}?child_process\.(?:exec|spawn|execSync)"),
]

# Names and words that the indicators over call sequences look for.
INSTALL_HOOKS = ("setup.py", "postinstall", "preinstall")
DYNAMIC_CODE = ("exec", "eval")
DYNAMIC_IMPORTS = ("__import__", "importlib.import_module")
SHELL_CALLS = ("os.system", "os.popen", "subprocess.run", "subprocess.Popen", "subprocess.call")
SYSTEM_CALLS = ("platform.uname", "platform.system", "socket.gethostname", "getpass.getuser", "os.uname")
DECODERS = ("base64.b64decode", "base64.urlsafe_b64decode", "codecs.decode", "bytes.fromhex")

# Severities of the indicator codes above.
SEVERITY = (
    dict.fromkeys((
            "EXS-001", "EXS-002", "EXS-003", "EXM-001", "EXM-003", "EXM-004", "EXM-006", "EXM-007", "EXM-008", "EXF-001", "EXF-002",
            "EXF-003", "EXF-004", "EXF-005", "SYS-001", "SYS-002", "SYS-003", "SYS-009", "NET-002", "NET-003", "NET-004", "NET-005",
            "NET-006", "NET-007", "NET-008", "DEF-003", "DEF-004", "DEF-005", "MET-006", "DOW-001", "DOW-002",
        ), "HIGH")
    | dict.fromkeys((
            "EXM-002", "EXM-005", "SYS-004", "SYS-005", "SYS-006", "SYS-007", "SYS-008", "NET-001", "NET-009", "NET-010", "DEF-001",
            "DEF-002", "MET-001", "MET-002", "MET-003", "MET-005",
        ), "MEDIUM")
    | dict.fromkeys((
            "DEF-006", "MET-004",
        ), "LOW")
)

# Codes that alone are weak, and prefixes of codes that make them strong within a file.
WEAK_CODES = (
    "EXM-001", "EXS-001", "SYS-005", "SYS-004", "DEF-006", "MET-004", "MET-001", "EXM-005", "DEF-003",
)
DECISIVE_PREFIXES = (
    "EXF-", "NET-002", "NET-007", "NET-008", "EXS-002", "EXS-003", "EXM-006", "EXM-008", "DEF-005",
)

# Phrases that make an advisory a malware report.
MALICIOUS_PHRASES = [
    "malicious package", "malicious code", "malware was found", "malware detected", "typosquatting", "typo-squat", "slopsquatting",
    "dependency confusion", "credential stealer", "info stealer", "infostealer", "supply chain attack", "backdoored", "contains a backdoor",
    "any version of this package", "exfiltrate", "exfiltrates", "harvest credentials",
]

# Addresses and domains that are no indicators, and paths that are.
INTERNAL_IP = r"^(?:127\.|10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|::1|fe80:)"
TRUSTED_DOMAINS = [
    "pypi.org", "files.pythonhosted.org", "registry.npmjs.org", "rubygems.org", "crates.io", "raw.githubusercontent.com", "github.com",
    "storage.googleapis.com", "go.dev", "proxy.golang.org",
]
SENSITIVE_PATH = r"(?i)/\.ssh/.+|/\.aws/credentials|/\.aws/config|/\.npmrc|/\.pypirc|/\.netrc|/etc/passwd|/etc/shadow|/proc/\d+/environ"

# Built-in modules of JavaScript's runtime, left out of imports.
NODE_BUILTINS = (
    "assert", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain", "events", "fs", "http",
    "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl",
    "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib",
)


def calls_of(table: dict[str, str]) -> list[tuple[str, str]]:
    """(name, dimension) of a catalog above."""
    return [(name, dimension) for dimension, names in table.items() for name in names]
