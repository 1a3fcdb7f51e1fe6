"""Fixed values that results must agree on: severities, patterns, name lists and classifications."""

from __future__ import annotations

from typing import NamedTuple

#: Weight of each severity; fixed values.
SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 5, "critical": 10}


class Rule(NamedTuple):
    name: str
    pattern: str
    severity: str | None
    cwe: str | None
    description: str = ""
    cve: str | None = None


#: Built-in secret rules; fixed values.
SECRETS = (
    Rule("aws-access-key-id", r"\b(AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b", "critical", "CWE-798", "AWS access key id"),
    Rule("private-key-block", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----", "critical", "CWE-798", "private key block"),
    Rule("github-token", r"\b(ghp|gho|ghu|ghs|ghr)_[0-9A-Za-z]{36,}\b", "critical", "CWE-798", "GitHub token"),
    Rule("slack-token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b", "high", "CWE-798", "Slack token"),
    Rule("generic-api-key", r"(?i)\b(api[_-]?key|apikey|secret[_-]?key|auth[_-]?token)\b\s*[:=]\s*['\"][0-9A-Za-z_\-]{16,}['\"]", "high", "CWE-798", "API key assignment"),
    Rule("password-in-url", r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@", "high", "CWE-522", "password in a URL"),
)
#: Personal data: label of the snippet by rule; fixed values.
PERSONAL = (
    Rule("pii-email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "medium", "CWE-359", "email address"),
    Rule("pii-ssn", r"\b\d{3}-\d{2}-\d{4}\b", "high", "CWE-359", "US SSN"),
    Rule("pii-credit-card", r"\b\d(?:[ \-]?\d){12,18}\b", "high", "CWE-359", "credit card number"),
    Rule("pii-phone", r"\b(?:\+?1[ .\-])?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}\b", "low", "CWE-359", "phone number"),
    Rule("pii-iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "medium", "CWE-359", "IBAN"),
)
#: Log events, in order; fixed values.
LOG = (
    Rule("log-auth-failure", r"Failed password for (?:invalid user )?(\S+) from (\d+\.\d+\.\d+\.\d+)", "medium", "CWE-287"),
    Rule("log-invalid-user", r"Invalid user (\S+) from (\d+\.\d+\.\d+\.\d+)", "medium", "CWE-287"),
    Rule("log-auth-failure", r"authentication failure;.*\buser=(\S+)", "medium", "CWE-287"),
    Rule("log-auth-success", r"Accepted (?:password|publickey) for (\S+) from (\d+\.\d+\.\d+\.\d+)", "info", "CWE-287"),
    Rule("log-sudo-command", r"sudo:.*COMMAND=(\S.*)$", "low", "CWE-250"),
    Rule("log-root-session", r"session opened for user root(?:\(uid=0\))? by", "low", "CWE-250"),
    Rule("log-su-failure", r"FAILED su for (\S+)", "medium", "CWE-287"),
)
LOG_NAMES = ("auth.log", "secure", "syslog", "messages")
#: Indicators; fixed values.
INDICATORS = {
    "emails": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "urls": r"\b(?:https?|ftp)://[^\s\"'<>)\]]+",
    "ips": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "domains": r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b",
    "hashes": r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b",
}
INDICATOR_CAP = 1024
#: Protected names and lists, in order; fixed values.
BRANDS = ("google", "paypal", "microsoft", "apple", "amazon", "facebook", "instagram", "netflix", "github", "gitlab", "linkedin", "twitter", "dropbox", "adobe", "oracle", "cisco", "coinbase", "binance", "wellsfargo", "bankofamerica", "chase", "citibank", "outlook", "office365", "docusign")
MALWARE = ("flatmap-stream", "eslint-scope-malicious", "electorn", "crossenv", "cross-env.js", "d3.js-malware", "web3-essential", "colourama", "python3-dateutil-malware", "jeIlyfish", "ctx-malware", "pymafka")
POPULAR = ("lodash", "express", "react", "axios", "chalk", "commander", "webpack", "typescript", "jquery", "moment", "next", "eslint", "prettier", "requests", "urllib3", "numpy", "pandas", "django", "flask", "boto3", "setuptools", "cryptography", "pillow", "serde", "tokio", "anyhow", "regex", "clap", "libc", "rand")
NOT_TYPOSQUATS = ("preact", "nuxt", "nest")
HOOK_FLAGS = ("curl", "wget", "base64", "eval(", "eval ", "node -e", "| sh", "|sh", "| bash", "|bash")
SKIP_DIRS = ("node_modules", "target", "vendor", "dist", "build", ".next", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".gradle", ".terraform")
#: The second is where this engine keeps its own tables.
ALWAYS_SKIPPED = (".git", ".siftstone")


class Sink(NamedTuple):
    """A dangerous call: ``how`` the callee is compared with ``names`` (first in order wins)."""

    how: str  # contains, equals, iequals, last, last_prefix, prefix_loads
    names: tuple[str, ...]
    rule: str
    severity: str
    cwe: str
    what: str


#: Dangerous calls, in order; fixed values.
SINKS = (
    Sink("contains", ("Command::new", "process::Command"), "ast-process-command", "high", "CWE-78", "process execution"),
    Sink("contains", ("exec.Command",), "ast-exec-command", "high", "CWE-78", "os/exec command"),
    Sink("contains", ("Process.Start",), "ast-process-start", "high", "CWE-78", "Process.Start execution"),
    Sink("last", ("popen",), "ast-c-exec", "high", "CWE-78", "popen/exec process execution"),
    Sink("last_prefix", ("execl", "execv"), "ast-c-exec", "high", "CWE-78", "popen/exec process execution"),
    Sink("equals", ("Invoke-Expression",), "ast-powershell-iex", "high", "CWE-95", "PowerShell expression evaluation"),
    Sink("iequals", ("iex",), "ast-powershell-iex", "high", "CWE-95", "PowerShell expression evaluation"),
    Sink("contains", ("os.execute",), "ast-lua-os-execute", "high", "CWE-78", "Lua shell command execution"),
    Sink("last", ("loadstring",), "ast-eval", "high", "CWE-95", "code evaluation"),
    Sink("contains", ("Process.run", "Process.start"), "ast-dart-process", "high", "CWE-78", "Dart process execution"),
    Sink("contains", ("ProcessBuilder",), "ast-process-builder", "high", "CWE-78", "ProcessBuilder execution"),
    Sink("last", ("evaluate",), "ast-groovy-evaluate", "high", "CWE-95", "Groovy dynamic evaluation"),
    Sink("equals", ("child_process.exec", "child_process.execSync"), "ast-child-process", "high", "CWE-78", "child_process shell execution"),
    Sink("last", ("execSync",), "ast-child-process", "high", "CWE-78", "child_process shell execution"),
    Sink("equals", ("os.system",), "ast-os-command", "high", "CWE-78", "shell command execution"),
    Sink("equals", ("yaml.load",), "ast-yaml-load", "medium", "CWE-502", "yaml.load without SafeLoader"),
    Sink("prefix_loads", ("pickle",), "ast-pickle", "high", "CWE-502", "pickle deserialization of untrusted data"),
    Sink("last", ("eval",), "ast-eval", "high", "CWE-95", "code evaluation"),
    Sink("last", ("exec",), "ast-exec", "high", "CWE-95", "dynamic code execution"),
    Sink("last", ("system",), "ast-os-command", "high", "CWE-78", "shell command execution"),
    Sink("last", ("popen", "Popen", "check_output", "check_call"), "ast-subprocess", "medium", "CWE-78", "subprocess execution (audit for shell=True / untrusted input)"),
)
#: Sinks of tainted data, in order; fixed values.
TAINT_SINKS = (
    Sink("contains", ("exec.Command", "Command::new", "process::Command", "Process.Start"), "taint-command-injection", "critical", "CWE-78", "process execution"),
    Sink("last", ("popen",), "taint-command-injection", "critical", "CWE-78", "process execution"),
    Sink("last_prefix", ("execl", "execv"), "taint-command-injection", "critical", "CWE-78", "process execution"),
    Sink("equals", ("child_process.exec", "child_process.execSync"), "taint-command-injection", "critical", "CWE-78", "child_process shell execution"),
    Sink("last", ("execSync",), "taint-command-injection", "critical", "CWE-78", "child_process shell execution"),
    Sink("last", ("system",), "taint-command-injection", "critical", "CWE-78", "shell command execution"),
    Sink("last", ("Popen", "check_output", "check_call"), "taint-command-injection", "critical", "CWE-78", "subprocess execution"),
    Sink("last", ("eval",), "taint-code-injection", "critical", "CWE-95", "code evaluation"),
    Sink("last", ("exec",), "taint-code-injection", "critical", "CWE-95", "dynamic code execution"),
)
#: Sources of untrusted data: by last part, and by what the callee holds; fixed values.
SOURCE_LAST = ("input", "raw_input", "getenv", "gets")
SOURCE_PARTS = ("request.", "os.environ", "process.argv", "process.env", "req.body", "req.query", "req.params", "os.Args", "os.Getenv", "FormValue", "URL.Query", "env::var", "env::args", "Console.ReadLine", "Request.Query", "Request.Form", "QueryString", "ARGV", "ENV", "params")
#: Event categories: rule (or its prefix, with *) to category and action, in order; fixed values.
EVENTS = (
    ("log-auth-failure", "authentication", "failure"),
    ("log-invalid-user", "authentication", "failure"),
    ("log-su-failure", "authentication", "failure"),
    ("log-auth-success", "authentication", "success"),
    ("log-sudo-command", "privilege", "escalation"),
    ("log-root-session", "privilege", "escalation"),
    ("taint-*", "vulnerability", "exploit-path"),
    ("ast-*", "vulnerability", "detected"),
    ("clamav", "malware", "detected"),
    ("ioc-hash", "malware", "detected"),
    ("ioc-net", "threat", "detected"),
    ("breach-email", "threat", "detected"),
    ("typosquat-domain", "phishing", "detected"),
    ("brand-subdomain", "phishing", "detected"),
    ("supply-chain*", "supply-chain", "detected"),
    ("pii-*", "data-exposure", "exposed"),
    ("dns-private-resolution", "network", "anomaly"),
)
