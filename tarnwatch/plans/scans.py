"""Registered queries of the pattern scans: name -> (query, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import patterns as P
from ..sources.corpus import code_files, scannable
from . import duck


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scannable(code_files(spark, sf_dir))


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = F.posexplode(F.split(F.concat("role", F.lit(": "), "text"), "\n")).alias("pos", "text")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), lines).select("id", (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def on_code(operator, *more):
    return lambda spark, sf_dir: operator(_code(spark, sf_dir), *more)


QUERIES = {
    "cred_findings": (on_code(P.check_patterns, catalog.CREDENTIALS, "HARDCODED_CREDENTIAL"), duck.checked(catalog.CREDENTIALS, "HARDCODED_CREDENTIAL")),
    "jwt_misuse": (on_code(P.check_patterns, catalog.JWT_MISUSE, "JWT_MISUSE"), duck.checked(catalog.JWT_MISUSE, "JWT_MISUSE")),
    "authz_bypass": (on_code(P.check_patterns, catalog.AUTHZ_BYPASS, "AUTHZ_BYPASS"), duck.checked(catalog.AUTHZ_BYPASS, "AUTHZ_BYPASS")),
    "insecure_session": (on_code(P.check_patterns, catalog.INSECURE_SESSION, "INSECURE_SESSION"), duck.checked(catalog.INSECURE_SESSION, "INSECURE_SESSION")),
    "missing_auth_decorator": (on_code(P.missing_auth_decorator), duck.ROUTES),
    "cors_misconfig": (on_code(P.cors_misconfig), duck.CORS),
    "origin_missing": (on_code(P.origin_missing), duck.ORIGIN),
    "stream_ssrf": (on_code(P.stream_ssrf), duck.SSRF),
    "redirects": (on_code(P.redirects), duck.REDIRECTS),
    "js_tokens": (on_code(P.js_tokens), duck.JS_TOKENS),
    "network_bindings": (on_code(P.network_bindings), duck.BINDINGS),
    "framework_rollup": (on_code(P.framework_rollup), duck.FRAMEWORKS),
    "network_report": (on_code(P.network_report), duck.NETWORK),
    "no_auth_users": (lambda s, d: P.no_auth_repos(_code(s, d).withColumn("repo", F.regexp_extract("file", duck.OWNER, 1))), duck.NO_AUTH_USERS),
    "injection_hits": (lambda s, d: P.injection_hits(_chat(s, d)), duck.INJECTIONS),
    "sanitised_lines": (lambda s, d: P.sanitised(_chat(s, d)), duck.SANITISED),
    "search": (on_code(P.search, "auth|token", r"\.py$"), duck.SEARCH),
    "v1_keyword_lines": (lambda s, d: P.keyword_lines(code_files(s, d)), duck.KEYWORDS),
}
