"""Word lists, line grammars and texts that decide results and therefore must stay as they are."""

# --- levels, sources -------------------------------------------------------------------------------------------

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "UNKNOWN")

# order in which formats are tried; an earlier one wins a tie
FORMATS = ("nginx", "python", "docker", "kubernetes", "systemd")


NGINX_ACCESS = (
    r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) ([^"]+)" (\d{3}) (\S+)'
    r'(?: "([^"]*)" "([^"]*)")?(?: rt=([\d.]+))?$'
)
NGINX_ERROR = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (.+)$"

PYTHON_STD = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) (\w+) (?:[^:]+:\S+|\S+) (.*)$"
PYTHON_STD_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\w+) ([^:]+):\d+ (.*)$"
PYTHON_UVICORN = r'^(?:INFO|WARNING|ERROR|DEBUG|CRITICAL):\s+[\d.]+:\d+\s+-\s+"([^"]+)"\s+(\d+).*$'
PYTHON_PREFIXES = ("INFO:     ", "ERROR:    ")
TRACEBACK_HEADER = "Traceback (most recent call last):"
TRACEBACK_CLOSING = r"^[\w.]+: .+"

DOCKER_RFC = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}\.\d+)Z (stdout|stderr) F (.*)$"
DOCKER_PIPE = r"^([^|]+)\s*\|\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+(\w+)\s+(.*)$"

K8S_EVENT = r"^(\S+)\s+(Normal|Warning)\s+(\S+)\s+(\S+/\S+)\s+(.+)$"
K8S_KUBECTL = r"^([\w.-]+)\s+(\S+)\s+(.+)$"

SYSLOG = r"^(\w{3}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) (\S+?)(?:\[(\d+)\])?: (.*)$"
PRIORITY = r"^<(\d)>(.*)$"

GENERIC_ISO = r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})"
GENERIC_SLASHED = r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
GENERIC_LEVEL = r"\b(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL)\b"

# --- level words -------------------------------------------------------------------------------------------------

PYTHON_LEVELS = {
    "DEBUG": "DEBUG",
    "INFO": "INFO",
    "WARNING": "WARNING",
    "WARN": "WARNING",
    "ERROR": "ERROR",
    "CRITICAL": "CRITICAL",
}
DOCKER_LEVELS = {"ERROR": "ERROR", "WARN": "WARNING", "WARNING": "WARNING", "INFO": "INFO", "DEBUG": "DEBUG"}
CUSTOM_LEVELS = {
    "DEBUG": "DEBUG",
    "INFO": "INFO",
    "WARN": "WARNING",
    "WARNING": "WARNING",
    "ERROR": "ERROR",
    "ERR": "ERROR",
    "CRITICAL": "CRITICAL",
    "FATAL": "CRITICAL",
    "CRIT": "CRITICAL",
}
NGINX_ERROR_LEVELS = {"ERROR": "ERROR", "CRIT": "ERROR", "WARN": "WARNING"}

# --- message templates -------------------------------------------------------------------------------------------

# applied to the lowered message in this order; dotless i and long s count as letters of the Latin alphabet there
TEMPLATE_RULES = (
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<ID>"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "<IP>"),
    (r"(?:/[A-Za-z0-9_.\-~ıſ]+)+|(?:[a-zıſ]:\\(?:[^\\\s]+\\)*[^\\\s]+)", "<PATH>"),
    (r"\b[0-9a-f]{32,64}\b", "<ID>"),
    (r"\d+", "<NUM>"),
    (r"\s+", " "),
)
TOP_TIER_MARKS = ("ERROR", "CRITICAL", "CRIT]", "[CRIT")
SIGNAL_WORDS = (
    "exception",
    "traceback",
    "failed",
    "refused",
    "timeout",
    "killed",
    "crash",
    "fatal",
    "panic",
    "segfault",
    "oom",
    "memory",
    "disk",
    "permission",
)

# --- timeline ----------------------------------------------------------------------------------------------------

RESTART_WORDS = ("started", "starting", "listening")
RESOURCE_WORDS = ("oomkilled", "out of memory")

# --- root-cause rules, in rule order -------------------------------------------------------------------------------

DB_PORT = r":(5432|3306|27017)\b"
MEMORY = ("memoryerror", "oomkilled", "cannot allocate memory", "out of memory")
BAD_GATEWAY_WORD = r"\b50[234]\b"
BAD_GATEWAY_ANYWHERE = r"50[234]"
EXHAUSTION = ("no space left on device", "too many open files", "resource temporarily unavailable")
CONFIGURATION = ("invalid configuration", "environment variable not set")
CONFIGURATION_FILE = r"filenotfounderror.*\.(?:ya?ml|json|env)"
CODE_ERROR = ("traceback", "unhandled exception", "assertionerror")
NETWORK = (
    "dns resolution failed",
    "ssl certificate",
    "certificate expired",
    "tls handshake",
    "connection reset by peer",
)

DATABASE_EVIDENCE = (
    "connection refused to DB port",
    "too many connections",
    "password authentication failed",
    "SQLAlchemy operational error",
    "could not connect to server",
)
DEPENDENCY_EVIDENCE = (
    "Multiple 502/503/504 responses observed",
    "Upstream timeout / bad gateway messages",
    "Health check failures",
)
MEMORY_EVIDENCE = "OOM-related signals in logs"
CONFIGURATION_EVIDENCE = "Configuration-related errors in logs"
CODE_EVIDENCE = "Python tracebacks or exception strings present"
NO_RULE_EVIDENCE = "Insufficient distinctive signals in parsed logs"

# rule name -> (category, hypothesis, recommended actions)
RULES = {
    "database": (
        "database",
        "Database connectivity or authentication failure likely caused the outage.",
        (
            "Verify database availability and credentials.",
            "Check connection pool sizing and idle timeouts.",
            "Review DB logs for refused connections or auth errors.",
        ),
    ),
    "memory": (
        "memory",
        "Memory exhaustion or OOM kill likely involved.",
        (
            "Inspect container/pod memory limits and host memory pressure.",
            "Profile application memory usage and leaks.",
            "Scale or increase memory limits if legitimate growth.",
        ),
    ),
    "dependency": (
        "dependency",
        "Downstream or upstream dependency failure caused user-facing errors.",
        (
            "Check upstream services and load balancer configuration.",
            "Validate network paths between tiers.",
            "Review retry and timeout settings.",
        ),
    ),
    "resource_exhaustion": (
        "resource_exhaustion",
        "Disk or file descriptor exhaustion detected.",
        (
            "Free disk space or expand volumes.",
            "Raise ulimits / review file handle leaks.",
            "Rotate logs and audit large writes.",
        ),
    ),
    "configuration": (
        "configuration",
        "Misconfiguration or missing configuration caused startup/runtime failure.",
        (
            "Validate environment variables and mounted config files.",
            "Compare with known-good configuration templates.",
            "Add schema validation for config at startup.",
        ),
    ),
    "code_error": (
        "code_error",
        "Unhandled application exception indicates a code defect or unexpected input.",
        (
            "Triage stack trace to failing module.",
            "Add guards and tests around failing path.",
            "Deploy hotfix after root fix is verified.",
        ),
    ),
    "network": (
        "network",
        "Network, DNS, or TLS issues detected.",
        (
            "Verify DNS records and resolver health.",
            "Check TLS certificate validity and chain.",
            "Inspect firewall and security group rules.",
        ),
    ),
    "none": (
        "dependency",
        "No strong automated rule matched; manual investigation required.",
        (
            "Correlate with deployments and infra changes.",
            "Narrow time window around first customer impact.",
            "Collect metrics alongside logs for context.",
        ),
    ),
}

# --- report texts --------------------------------------------------------------------------------------------------

NO_TIMELINE = "- No significant timeline events extracted."
NO_ROOT_CAUSE = "- No root-cause hypothesis generated."
NO_ACTIONS = "- Gather metrics and narrow the failing component."
PREVENTION = (
    "- Add alerting on error-rate SLOs and dependency health.\n"
    "- Ensure structured logging with correlation IDs for faster future triage.\n"
    "- Track deployments against incident windows."
)
SECTIONS = (
    "Incident Summary",
    "Timeline",
    "Root Cause Analysis",
    "Impact Assessment",
    "Recommended Actions",
    "Prevention",
)

SYSTEM_PROMPT = """You are a senior Site Reliability Engineer writing an incident report.
You receive structured analysis data from an automated log analysis system.
Your job is to write a clear, actionable incident report.

Rules:
- Write for a technical audience (engineers, on-call responders)
- Be specific — reference actual error messages, timestamps, and counts from the data
- Do not invent information not present in the data
- Use clear severity language: P1 (Critical), P2 (High), P3 (Medium), P4 (Low)
- Keep the report under 500 words
- Format as clean Markdown with headers"""
