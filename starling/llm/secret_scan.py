"""Secrets in texts, told apart by how many owners of the corpus carry them.

Detectors find candidate spans in each whole text: the three of the contract, and
private key blocks, signed web tokens and tokens with a known beginning. The SHA-256 of each
candidate's value is then counted over the corpus by distinct repositories and
owners: a value that many owners carry is a copied example (of documentation or
a licence header, say); one that stays with few owners looks live.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import store

# Fixed values of the contract: kinds in their order, patterns, least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Public formats of key blocks, signed web tokens and tokens with a known beginning.
MORE = {
    "pem": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s,:]|-(?!----))+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
    "prefixed": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})",
}
MARKS = {"pem": ("PRIVATE KEY-----",), "jwt": ("eyJ",), "prefixed": ("_", "-", "AIza")}
KINDS = (*BASE_KINDS, *MORE)

_MORE = {kind: re.compile(pattern) for kind, pattern in MORE.items()}
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_WORDS = ("pass", "secret", "token", "api")

#: A value with this many owners at least is taken for a copied example.
COPIED_OWNERS = 3

SCAN_TYPE = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "found array<struct<kind: string, start: int, end: int, value_from: int, hash: string>>"
)


def find(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the value starts) in code points, by start and then kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # A maximal run of hex digits is long enough exactly if {24,} matches from its start.
    found += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    for kind, pattern in _MORE.items():
        if any(mark in text for mark in MARKS[kind]):
            found += [(kind, m.start(), m.end(), m.start()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_text(text: str | None) -> dict:
    found = find(text)
    joined = lambda kinds: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found if k in kinds)
    return {
        **{f"n_{kind}": sum(x[0] == kind for x in found) for kind in BASE_KINDS},
        "base_sha256": hashlib.sha256(joined(BASE_KINDS).encode()).hexdigest(),
        "spans": joined(KINDS),
        "found": [{"kind": k, "start": a, "end": b, "value_from": v, "hash": hashlib.sha256(text[v:b].encode("utf-8", "surrogatepass")).hexdigest()} for k, a, b, v in found],
    }


def _scan_udf():
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(SCAN_TYPE))

    @F.arrow_udf(SCAN_TYPE)
    def scan(text: pa.Array) -> pa.Array:
        return pa.array([scan_text(x) for x in text.to_pylist()], type=kind)

    return scan


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """found (hash, repo, owner): per hash its distinct repositories and owners, and whether it is a copied example.

    Distinct (hash, repo, owner) first: a value that a third of all rows hold comes
    down to its repositories before any shuffle by hash."""
    distinct = found.select("hash", "repo", "owner").distinct()
    per = distinct.groupBy("hash").agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
    return per.withColumn("copied", F.col("n_owners") >= copied_owners)


def scan_secrets(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), keep: tuple[str, ...] = ("doc_id",), copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """A row per row of docs: columns `keep`, counts and spans by kind, and n_live, n_copied, live (kinds and places of
    the live-looking values) and live_values (the same as kind:start:end by start, comma-joined).

    A null or empty text has no spans. A null owner or repository counts as one
    owner or repository of its own. Repeated rows are scanned and returned each.
    An empty table gives no rows. Columns of docs beyond those named are ignored.
    """
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\0null"))
    repo = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"r{i}") for i, c in enumerate(repo_cols)]))
    scanned = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], owner.alias("owner"), repo.alias("repo"), _scan_udf()(F.col(text_col)).alias("s"))
    rows = store(scanned.select("*", "s.*").drop("s").withColumn("rid", F.monotonically_increasing_id()), "secrets")
    found = rows.where(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("f")).select("rid", "repo", "owner", "f.*")
    judged = found.join(ownership(found, copied_owners), "hash")
    per_row = judged.groupBy("rid").agg(
        F.count(F.when(~F.col("copied"), 1)).alias("n_live"), F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
        F.sort_array(F.collect_list(F.when(~F.col("copied"), F.struct("value_from", "end", "kind")))).alias("live"),
    )
    out = rows.join(per_row, "rid", "left")
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"), "live",
        F.coalesce(F.array_join(F.transform("live", lambda x: F.concat_ws(":", x["kind"], x["value_from"], x["end"])), ","), F.lit("")).alias("live_values"),
    )


#: Copied values that are shipped to the tasks as a set; beyond, live spans are joined to the rows.
COPIED_SHIPPED = 500_000
MASK = "[REDACTED]"


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with MASK for each span, overlapping ones as one."""
    if not text or not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def redact_live(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """docs with the values of live-looking secrets masked; copied examples and all other columns stay as they are.

    The corpus is scanned once for the counts and once to mask, so no text is shuffled."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\0null"))
    repo = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"r{i}") for i, c in enumerate(repo_cols)]))
    scan = _scan_udf().asNondeterministic()  # else Spark filters by the scan's result first, so scans each text twice
    found = docs.select(owner.alias("owner"), repo.alias("repo"), scan(F.col(text_col)).alias("s")).select("owner", "repo", F.explode("s.found.hash").alias("hash"))
    copied = store(ownership(found, copied_owners).where("copied").select("hash"), "secrets-copied")

    if copied.count() <= COPIED_SHIPPED:
        examples = docs.sparkSession.sparkContext.broadcast({r[0] for r in copied.collect()})

        @F.arrow_udf("string")
        def mask(text: pa.Array) -> pa.Array:
            def one(x):
                spans = [(v, b) for _, _, b, v in find(x) if hashlib.sha256(x[v:b].encode("utf-8", "surrogatepass")).hexdigest() not in examples.value]
                return redact(x, spans)

            return pa.array([one(x) for x in text.to_pylist()], type=pa.string())

        return docs.withColumn(text_col, mask(F.col(text_col)))

    packed = store(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"), _scan_udf()(F.col(text_col))["found"].alias("found")), "secrets-packed")
    live = packed.where(F.size("found") > 0).select("rid", F.explode("found").alias("f")).select("rid", "f.*").join(copied, "hash", "left_anti")
    spans = live.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("value_from", "end"))).alias("spans"))

    @F.arrow_udf("string")
    def mask_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([redact(x, [(s["value_from"], s["end"]) for s in y or ()]) for x, y in zip(text.to_pylist(), spans.to_pylist())], type=pa.string())

    joined = packed.join(spans, "rid", "left")
    masked = joined.withColumn("masked", mask_spans(F.col("row")[text_col], F.col("spans")))
    return masked.select(*[F.col("masked").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
