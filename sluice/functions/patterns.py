"""Regular expressions that Spark (java.util.regex) and RE2 read alike, put together from parts."""

from __future__ import annotations

#: Connection schemes; a scheme may carry a driver, as in ``mysql+pymysql``.
SCHEMES = ("amqp", "cockroachdb", "mariadb", r"mongodb(?:\+srv)?", "mssql", "mysql", "oracle", "postgres(?:ql)?", "redis", "sqlite", "sqlserver")
#: Types in the order in which they are looked for in a connection string.
TYPES = ("postgresql", "postgres", "mysql", "mariadb", "mongodb", "redis", "amqp", "mssql", "sqlserver", "oracle", "sqlite", "jdbc", "cockroachdb")
SECRETS = ("passwd", "password", "pwd", "secret", "token")
PLACEHOLDERS = ("*", "None", "null")
LOCAL_HOSTS = ("0.0.0.0", "127.0.0.1", "localhost")

ASSIGN = r"\s*[:=]\s*"
QUOTE = r"[\"']"
#: A bare value ends at a quote, a comment, a comma or a blank.
BARE = r"[^\"'#,\s]+"
QUOTED = rf"{QUOTE}([^\"']+){QUOTE}"

URL = r"(?i)(?:ftp|https?|wss?)://[^\s\"'<>)\]},;]+"
CONNECTION = rf"(?i)(?:{'|'.join(SCHEMES)})(?:\+[a-z0-9]+)?://[^\s\"']+"
JDBC = r"(?i)jdbc:[^\s\"']+"
JDBC_PARTS = r"(?i)jdbc:\w+://([^/:@]+)" + r"(?::(\d+))?" + r"(?:/([^?;\s]+))?"
DRIVER = rf"(?i)(?:connect|createConnection|create_engine)\s*\(\s*{QUOTED}"

USER_PASSWORD = r"://([^:@]+:)[^@/]+@"
PASSWORD = r"://:[^@/]+@"
SECRET = rf"(?i)({'|'.join(SECRETS)}){ASSIGN}{QUOTE}?{BARE}"

_KEY = r"(?i)(?:^|[\s,])"
_DB = r"(?:db[_-]?)?"
#: Field -> pattern of ``key = value`` and ``key: value`` lines.
KEY_VALUE = {
    "host": rf"{_KEY}{_DB}host(?:name)?{ASSIGN}{QUOTE}?({BARE})",
    "port": rf"{_KEY}{_DB}port{ASSIGN}{QUOTE}?([0-9]{{1,5}})",
    "user": rf"{_KEY}{_DB}(?:uid|user(?:name)?){ASSIGN}{QUOTE}?({BARE})",
    "database": rf"{_KEY}{_DB}(?:database|dbname|db){ASSIGN}{QUOTE}?({BARE})",
    "schema": rf"{_KEY}schema{ASSIGN}{QUOTE}?({BARE})",
}
#: Field -> pattern of dictionary literals with quoted keys.
DICT_VALUE = {
    "host": rf"(?i){QUOTE}host(?:name)?{QUOTE}\s*:\s*{QUOTED}",
    "port": rf"(?i){QUOTE}port{QUOTE}\s*:\s*([0-9]{{1,5}})",
    "user": rf"(?i){QUOTE}user(?:name)?{QUOTE}\s*:\s*{QUOTED}",
    "database": rf"(?i){QUOTE}(?:database|dbname|db){QUOTE}\s*:\s*{QUOTED}",
    "schema": rf"(?i){QUOTE}schema{QUOTE}\s*:\s*{QUOTED}",
}

ENV_LINE = r"(?i)^(?:export\s+)?([a-z][a-z0-9_]*)\s*=\s*(.+)$"
_ENV = {
    "AMQP": "URL",
    "DATABASE": "URI URL",
    "DB": "DATABASE HOST NAME PORT SCHEMA URI URL USER USERNAME",
    "JDBC": "URL",
    "MONGO": "URL",
    "MONGODB": "HOST URI",
    "MYSQL": "DATABASE HOST URL USER",
    "ORACLE": "HOST",
    "POSTGRES": "URL",
    "POSTGRESQL": "URL",
    "RABBITMQ": "URL",
    "REDIS": "URI URL",
    "SPRING_DATASOURCE": "URL USERNAME",
    "SQLALCHEMY": "BINDS DATABASE_URI",
}
#: The variables that are known to say where a database is.
ENV_NAMES = tuple(sorted([f"{a}_{b}" for a, bs in _ENV.items() for b in bs.split()] + ["PG" + x for x in ("DATABASE", "HOST", "PORT", "USER")]))

#: Where Python's ``str.splitlines`` splits.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
