"""Ad-hoc questions to a corpus: list, read, search and run, as DataFrames."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import catalog
from .operators import patterns as P
from .operators import review as R
from .operators import structure as S
from .sources.corpus import scannable

#: Scan modules by name: (files) -> findings.  ``register`` adds to them.
MODULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "credentials": lambda f: P.check_patterns(f, catalog.CREDENTIALS, "HARDCODED_CREDENTIAL"),
    "jwt": lambda f: P.check_patterns(f, catalog.JWT_MISUSE, "JWT_MISUSE"),
    "authz": lambda f: P.check_patterns(f, catalog.AUTHZ_BYPASS, "AUTHZ_BYPASS"),
    "session": lambda f: P.check_patterns(f, catalog.INSECURE_SESSION, "INSECURE_SESSION"),
    "routes": P.missing_auth_decorator,
    "cors": P.cors_misconfig,
    "origin": P.origin_missing,
    "ssrf": P.stream_ssrf,
    "redirect": P.redirects,
    "network": P.network_report,
    "js": P.js_tokens,
    "auth_params": S.unvalidated_auth,
    "streams": S.stream_without_auth,
    "messages": S.messages_without_binding,
    "v2": S.taint_v2,
}


BUILT_IN = dict(MODULES)


def register(name: str, module: Callable[[DataFrame], DataFrame]) -> None:
    MODULES[name] = module


class Corpus:
    """files (repo, file, content); nothing runs before an action on what a method returns."""

    def __init__(self, files: DataFrame) -> None:
        self.files = files

    def list(self, prefix: str = "", most: int = 300) -> DataFrame:
        """Paths below prefix, which is a folder: ``src`` doesn't list ``src2``."""
        folder = prefix.rstrip("/")
        found = self.files.where(F.startswith("file", F.lit(folder + "/"))) if folder else self.files
        return found.select("repo", "file").orderBy("repo", "file").limit(most)

    def read(self, file: str, start: int = 1, end: int = 400, most: int = 400) -> DataFrame:
        return R.read_lines(self.files.where(F.col("file") == file), start, end, most).orderBy("repo", "line")

    def search(self, pattern: str, glob: str | None = None, most: int = 30) -> DataFrame:
        """Matching lines of files whose path or name fits the glob, or whose name ends with it."""
        if not glob:
            return P.search(self.files, pattern, None, most)
        fits = fnmatch.translate(glob).replace(r"(?s:", "(?s)(?:").replace(r"\z", "$").replace(r"\Z", "$")
        name = F.substring_index("file", "/", -1)
        return P.search(self.files.where(F.col("file").rlike("^" + fits) | name.rlike("^" + fits) | F.endswith("file", F.lit(glob))), pattern, None, most)

    def run(self, module: str) -> DataFrame:
        return MODULES[module](scannable(self.files))

    def scan(self, modules: list[str] | None = None, flags: dict[str, bool] | None = None) -> DataFrame:
        """Findings of all modules in one frame: repo, module, type, severity, file, line, match, detail.  A module that flags say is off is left out; one they don't name is on."""
        columns = {"type": "string", "severity": "string", "file": "string", "line": "long", "match": "string", "detail": "string"}
        wanted = [m for m in modules or sorted(MODULES) if (flags or {}).get(m, True)]
        if not wanted:
            return self.files.sparkSession.createDataFrame([], "repo string, module string, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
        together = [m for m in wanted if m in P.FUSED and MODULES[m] is BUILT_IN[m]]  # one scan for all of these
        out = P.fused(scannable(self.files), together) if together else None
        for m in (m for m in wanted if m not in together):
            found = self.run(m)
            same = found.select("repo", F.lit(m).alias("module"), *[(F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
            out = same if out is None else out.unionByName(same)
        return out
