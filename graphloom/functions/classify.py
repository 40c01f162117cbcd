"""Classification as column expressions: every one stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a name's sensitivity, strongest first.
SENSITIVE_WORDS = {
    "SECRET": ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "private_key", "privatekey", "access_key", "accesskey", "secret_key", "secretkey"],
    "PII": ["email", "phone", "address", "ssn", "social_security", "dob", "date_of_birth", "birthdate", "firstname", "first_name", "lastname", "last_name", "fullname", "full_name", "zipcode", "zip_code", "postal"],
    "AUTH": ["session", "auth", "jwt", "cookie", "bearer", "credential", "oauth", "refresh_token", "id_token"],
    "FINANCIAL": ["amount", "price", "balance", "credit", "payment", "card_number", "cardnumber", "cvv", "expiry", "account_number", "routing", "iban", "swift"],
}

# Domains of sink subtypes.
DOMAIN_OF_SUBTYPE = {
    "LOG": ["log_write", "display"],
    "HTML": ["http_response", "redirect"],
    "SHELL": ["system_exec"],
    "SQL": ["sql_query", "db_read", "db_write"],
    "FILE": ["file_read", "file_write", "file_access"],
    "URL": ["api_call", "url_fetch"],
    "XML": ["xml_parse"],
    "LDAP": ["ldap_query"],
}
# Patterns over code where the subtype says nothing, first match wins.
DOMAIN_PATTERNS = {
    "LDAP": r"(?i)\b(ldap|ldap_search|ldap_bind|ldap_connect|DirContext|InitialDirContext|LdapContext|searchFilter)\b",
    "SHELL": r"(?i)\b(exec\s*\(|spawn\s*\(|system\s*\(|popen|child_process|Runtime\.exec|Runtime\.getRuntime|ProcessBuilder|shell_exec|os\.system|subprocess|execSync|execFile|ShellExecute)\b",
    "SQL": r"(?i)\b(query|execute|prepare|sql|SELECT\s|INSERT\s|UPDATE\s|DELETE\s|\.run\s*\(|\.exec\s*\(|Statement|ResultSet|hibernate|HQL|JPQL|criteria|createQuery|createNativeQuery|preparedStatement)\b",
    "XML": r"(?i)\b(XQuery|xquery|xmldb|XPath|xpath|SAXParser|DocumentBuilder|XMLReader|XMLParser|parseXML|etree\.parse|xml\.parse|DTD|DOCTYPE)\b",
    "URL": r"(?i)\b(URL|openStream|openConnection|HttpClient|HttpURLConnection|fetch\s*\(|axios|request\s*\(|http\.get|https\.get|curl|wget|URLConnection|HttpGet|HttpPost|RestTemplate|WebClient|\.getInputStream\s*\(\s*\))\b",
    "HTML": r"(?i)\b(render|\.send\s*\(|\.write\s*\(|\.html\s*\(|innerHTML|document\.write|\.append\(|response\.getWriter|HttpServletResponse|\.setContentType.*text\/html)\b",
    "FILE": r"(?i)\b(readFile|writeFile|open\s*\(|createStream|FileInputStream|FileOutputStream|fopen|fwrite|fread|createReadStream|createWriteStream|path\.join|path\.resolve|File\s*\(|RandomAccessFile|BufferedReader.*FileReader)\b",
}
# Weakness numbers that concern one domain of sinks only.
DOMAINS_OF_CWE = {
    "SHELL": [77, 78, 88, 214],
    "SQL": [89, 564],
    "HTML": [79, 80, 81, 82, 83, 84, 85, 86, 87, 75, 138, 150, 692, 790, 791],
    "LOG": [117],
    "LDAP": [90],
    "XML": [91, 643, 652, 827],
    "URL": [918],
    "FILE": [22, 23, 36, 73],
}

# The eleven ways in which a value can be safe, in bit order.
STATES = ("sql_safe", "xss_safe", "shell_safe", "path_safe", "ldap_safe", "xpath_safe", "xxe_safe", "deserialize_safe", "redirect_safe", "ssti_safe", "log_safe")
# What each neutralising subtype makes safe.
NEUTRALIZED = {
    "sanitize_html": ["xss_safe"],
    "sanitize_sql": ["sql_safe"],
    "sanitize_shell": ["shell_safe"],
    "sanitize_path": ["path_safe"],
    "sanitize_ldap": ["ldap_safe"],
    "sanitize_xpath": ["xpath_safe"],
    "sanitize_log": ["log_safe"],
    "encode_url": ["redirect_safe"],
    "hash": list(STATES),
    "encrypt": ["sql_safe", "xss_safe", "shell_safe", "path_safe", "ldap_safe", "xpath_safe", "ssti_safe", "log_safe"],
    "sanitize": ["xss_safe", "shell_safe", "ssti_safe", "log_safe"],
    "encode": ["xss_safe", "log_safe", "ssti_safe"],
    "escape": ["xss_safe", "log_safe", "ssti_safe"],
    "validate": ["path_safe", "redirect_safe"],
    "parameterize": ["sql_safe", "ldap_safe", "xpath_safe"],
    "prepared_statement": ["sql_safe", "ldap_safe", "xpath_safe"],
}
NEUTRALIZED_PREFIX = {"sanitize_": ["xss_safe", "shell_safe"], "encode_": ["xss_safe", "log_safe"], "escape_": ["xss_safe", "log_safe"], "validate_": ["path_safe", "redirect_safe"]}
NEUTRALIZER_PREFIXES = ("sanitize", "encode", "escape", "hash", "encrypt", "validate", "parameterize")
NEUTRALIZER_OF = {
    "sql_safe": "parameterize", "xss_safe": "encode", "shell_safe": "safe_api", "path_safe": "validate", "ldap_safe": "parameterize", "xpath_safe": "parameterize",
    "xxe_safe": "configure", "deserialize_safe": "validate", "redirect_safe": "validate", "ssti_safe": "encode", "log_safe": "encode",
}


def first_of(cases: list[tuple[Column, str]], default: str | Column) -> Column:
    """CASE WHEN in order."""
    return reduce(lambda acc, c: acc.when(c[0], F.lit(c[1])), cases[1:], F.when(cases[0][0], F.lit(cases[0][1]))).otherwise(default)


def sensitivity(name: Column) -> Column:
    low = F.lower(name)
    return first_of([(low.rlike("|".join(words)), level) for level, words in SENSITIVE_WORDS.items()], "NONE")


def trust_boundary(node_type: Column, subtype: Column) -> Column:
    is_file = subtype.contains("file")
    return first_of(
        [
            ((node_type == "INGRESS") & (subtype == "env_read"), "environment"),
            ((node_type == "INGRESS") & (subtype == "file_read"), "filesystem"),
            (node_type == "INGRESS", "network_external"),
            (node_type.isin("STORAGE", "EGRESS") & is_file, "filesystem"),
            (node_type == "STORAGE", "storage"),
            ((node_type == "EXTERNAL") & (subtype == "system_exec"), "subprocess"),
            (node_type.isin("EXTERNAL", "EGRESS"), "network_external"),
            (node_type == "META", "app_config"),
            (node_type == "AUTH", "auth"),
            (node_type == "RESOURCE", "subprocess"),
        ],
        "",
    )


def sink_domain(subtype: Column, code: Column, dev_gated: Column | None = None) -> Column:
    cases = [] if dev_gated is None else [(dev_gated, "LOG")]
    cases += [(subtype.isin(*subs), domain) for domain, subs in DOMAIN_OF_SUBTYPE.items()]
    text = F.concat_ws(" ", code, subtype)
    cases += [(text.rlike(pattern), domain) for domain, pattern in DOMAIN_PATTERNS.items()]
    return first_of(cases, "UNKNOWN")


def cwe_fits_domain(cwe: Column, domain: Column) -> Column:
    """True unless the weakness belongs to other domains than a known one."""
    allowed = reduce(lambda acc, kv: acc.when(cwe.isin(*[f"CWE-{n}" for n in kv[1]]), F.lit(kv[0])), DOMAINS_OF_CWE.items(), F.when(F.lit(False), F.lit("")))
    return allowed.isNull() | (domain == "UNKNOWN") | (allowed == domain)


def state_bits(names: list[str]) -> int:
    return sum(1 << STATES.index(n) for n in names)


def neutralizes(subtype: Column) -> Column:
    """Whether the subtype, or its prefix before ``_``, is a neutralising one."""
    return F.coalesce((subtype == "prepared_statement") | subtype.rlike(f"^({'|'.join(NEUTRALIZER_PREFIXES)})(_|$)"), F.lit(False))


def neutralized_bits(subtype: Column) -> Column:
    """The states that the subtype makes safe, as bits."""
    exact = [(subtype == s, state_bits(names)) for s, names in NEUTRALIZED.items()]
    prefix = [(subtype.startswith(p), state_bits(names)) for p, names in NEUTRALIZED_PREFIX.items()]
    return first_of(exact + prefix, F.lit(0)).cast("int")


def required_state(subtype: Column) -> Column:
    """The state that a sink asks for; null where it asks for none."""
    pairs = [
        (subtype.contains("sql") | subtype.isin("db_read", "db_write", "db_stored_proc"), "sql_safe"),
        (subtype.contains("html_") | subtype.isin("http_response", "template_render", "xss_sink"), "xss_safe"),
        (subtype.contains("shell_") | subtype.isin("system_exec", "process_spawn"), "shell_safe"),
        (subtype.startswith("file_"), "path_safe"),
        (subtype.contains("ldap_"), "ldap_safe"),
        (subtype.contains("xpath_"), "xpath_safe"),
        (subtype.contains("xml_"), "xxe_safe"),
        (subtype.rlike("deserialize|unserialize|unpickle"), "deserialize_safe"),
        (subtype.contains("redirect"), "redirect_safe"),
        (subtype == "template_exec", "ssti_safe"),
        (subtype == "log_write", "log_safe"),
    ]
    return first_of(pairs, F.lit(None).cast("string"))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), severity), F.lit(0)).cast("int")


def missing_category(missing: Column) -> Column:
    """The leading word of what a finding misses."""
    word = F.regexp_extract(missing, r"^(\w+)", 1)
    return F.when(word == "", "UNKNOWN").otherwise(word)


def range_of(low: Column, high: Column) -> Column:
    """An interval; bounded if both ends are finite."""
    finite = (F.abs(low) < float("inf")) & (F.abs(high) < float("inf"))
    return F.struct(low.alias("min"), high.alias("max"), finite.alias("bounded"))


def narrow(a: Column, b: Column) -> Column:
    return range_of(F.greatest(a["min"], b["min"]), F.least(a["max"], b["max"]))


def excludes_zero(r: Column) -> Column:
    return (r["min"] > 0) | (r["max"] < 0)


def boundaries_crossed(boundaries: Column) -> Column:
    named = F.filter(F.array_distinct(boundaries), lambda b: b.isNotNull() & (b != ""))
    return F.greatest(F.size(named) - 1, F.lit(0))


def language_of(path: Column) -> Column:
    """By extension; an unknown one counts as JavaScript."""
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    # Extension to language.
    known = {".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".php": "php", ".rb": "ruby", ".cs": "csharp", ".kt": "kotlin", ".swift": "swift"}
    return first_of([(ext == e, lang) for e, lang in known.items()], "javascript")


def strip_literals(code: Column) -> Column:
    """Quoted strings emptied."""
    return F.regexp_replace(F.regexp_replace(code, r'"(?:\\.|[^"\\\n])*"', '""'), r"'(?:\\.|[^'\\\n])*'", "''")


def storage_target(code: Column) -> Column:
    """What a piece of code reads or writes: (kind, name); null if it names nothing."""
    table = F.regexp_extract(code, r"(?i)\b(?:from|into|update|join)\s+[`\"']?([a-z_][\w.]*)", 1)
    env = F.regexp_extract(code, r"(?:process\.env\.|os\.environ\[['\"]|getenv\(['\"])(\w+)", 1)
    file = F.regexp_extract(code, r"(?:readFile|writeFile|open|createReadStream|createWriteStream|appendFile)\w*\s*\(\s*['\"]([^'\"]+)['\"]", 1)
    orm = F.regexp_extract(code, r"(?:prisma|db|knex|mongoose)\.(\w+)\.(?:find|create|update|delete|insert|aggregate|upsert)\w*", 1)
    return F.coalesce(*[F.when(v != "", F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("name") if kind == "table" else v.alias("name"))) for kind, v in (("table", table), ("env", env), ("file", file), ("table", orm))])
