"""Users, roles and tokens kept as values; what may call what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scan

ROLES = ("admin", "readwrite", "readonly")
USER = "username string, roles array<string>, created_at bigint, _bad string"
#: The first suffix that a method ends with decides; all others need admin.
RULES = [
    (("Get", "Scan"), ["readonly", "readwrite", "admin"]),
    (("Put", "Delete", "BeginTxn", "CommitTxn", "RollbackTxn"), ["readwrite", "admin"]),
    (("CreateUser",), ["admin"]),
]
OPEN = "Authenticate"
METHODS = ["Get", "Put", "Delete", "Scan", "ListCF", "CreateCF", "DeleteCF", "BeginTxn", "CommitTxn", "RollbackTxn", "CreateUser", "ChangePassword", "ListUsers", "Authenticate"]


def users(log: DataFrame, cf: str = "__auth__") -> DataFrame:
    """Users from JSON values under user: keys; malformed ones are skipped."""
    rows = scan.scan(log, "user:", cf).select(F.from_json("value", USER, {"columnNameOfCorruptRecord": "_bad"}).alias("u"))
    return rows.where("u._bad is null and u.username is not null").select("u.username", "u.roles", "u.created_at")


def username(name: Column) -> Column:
    """Names are kept trimmed and in lower case."""
    return F.lower(F.trim(name))


def user_key(name: Column) -> Column:
    return F.concat(F.lit("user:"), username(name))


def role_list(text: Column) -> Column:
    """Roles given as text between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda r: F.trim(r)), lambda r: r != "")


def path_key(path: Column) -> Column:
    """The key that an HTTP path names; null if it names none."""
    return F.nullif(F.regexp_extract(path, "^/api/v1/kv/(.+)$", 1), F.lit(""))


def has_any(roles: Column, required: Column) -> Column:
    return F.coalesce(F.arrays_overlap(roles, required), F.lit(False))


def has_all(roles: Column, required: Column) -> Column:
    return F.size(F.array_except(required, roles)) == 0


def valid_role(role: Column) -> Column:
    return role.isin(*ROLES)


def required_roles(method: Column) -> Column:
    """Roles of which a method asks one; an empty list asks none."""
    found = F.when(method.endswith(OPEN), F.array().cast("array<string>"))
    for suffixes, roles in RULES:
        for s in suffixes:
            found = found.when(method.endswith(s), F.array(*map(F.lit, roles)))
    return found.otherwise(F.array(F.lit("admin")))


def may_call(method: Column, roles: Column) -> Column:
    return method.endswith(OPEN) | has_any(roles, required_roles(method))


def matrix(people: DataFrame) -> DataFrame:
    """Every user and method, and whether it is allowed."""
    own = people.select("username", "roles", F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    return own.select("username", "method", may_call(F.concat(F.lit("/kv.Store/"), "method"), F.col("roles")).alias("allowed"))


def path_roles(path: Column, verb: Column) -> Column:
    """Roles that the key-value paths of the HTTP surface ask for, by verb; other paths need admin, login none."""
    read, write = (F.array(*map(F.lit, r)) for r in (RULES[0][1], RULES[1][1]))
    kv = F.when(verb == "GET", read).when(verb.isin("PUT", "DELETE"), write).when((verb == "POST") & (path == "/api/v1/kv/scan"), read).when(verb == "POST", write).otherwise(F.array(F.lit("admin")))
    return F.when(path == "/api/v1/auth/login", F.array().cast("array<string>")).when(path.startswith("/api/v1/kv/"), kv).otherwise(F.array(F.lit("admin")))


def bearer(header: Column) -> Column:
    """The token of an authorization header, empty if there is none."""
    return F.trim(F.regexp_extract(header, "^Bearer (.*)$", 1))


def claims(token: Column) -> Column:
    """The claims of a signed token, unverified: its middle part, base 64 with the alphabet for addresses."""
    body = F.translate(F.split(token, "\\.")[1], "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.unbase64(padded).cast("string"), "sub string, roles array<string>, exp bigint, iat bigint")


def token(header: Column, payload: Column, signature: Column) -> Column:
    part = lambda c: F.translate(F.base64(c.cast("binary")), "+/=\r\n", "-_")
    return F.concat(part(header), F.lit("."), part(payload), F.lit("."), part(signature))


def error_code(status: Column) -> Column:
    return F.when(status == 401, "UNAUTHORIZED").when(status == 403, "FORBIDDEN").otherwise("AUTH_ERROR")
