"""Secret scans by corpus-wide ownership frequency.

Three base patterns and one wide candidate pattern run over every whole text. The
SHA-256 of each candidate value is aggregated over the corpus by distinct
repositories and owners: a value that several owners hold, or one owner in many
repositories, is a copied example; another looks live. Wide candidates (long mixed
tokens in no assignment) become spans of the kind ``owned`` only if they look live.

Defined cases: a null text is empty; a null owner or repository is one of its
own; rows with equal ids are separate documents of one repository; overlapping
spans of different kinds all count; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import lists, materialize, record

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is one leftmost match, so its least length may be asked at once
WIDE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
MIN_DIGITS = MIN_LETTERS = 4


def scan(text: str | None) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """Base spans and wide candidates of a text: (start, kind, end, value), in order."""
    if not text:
        return [], []
    base = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    base.sort()
    wide = []
    for m in WIDE.finditer(text):
        s, v = m.start(), m.group()
        if len(DIGIT.findall(v)) >= MIN_DIGITS and len(LETTER.findall(v)) >= MIN_LETTERS:
            if not any(a < m.end() and s < e for a, _, e, _ in base):
                wide.append((s, 3, m.end(), v))
    return base, wide


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def _scan(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("sha", pa.string())]))
    for b in batches:
        ids, texts, owners, repos = lists(b, "doc_id", "text", "owner", "repo")
        found = [scan(t) for t in texts]
        yield record(
            doc_id=(ids, pa.int64()),
            owner=(owners, pa.string()),
            repo=(repos, pa.string()),
            counts=([[sum(k == j for _, k, _, _ in base) for j in range(3)] for base, _ in found], pa.list_(pa.int64())),
            base=([_join(base) for base, _ in found], pa.string()),
            cand=([[{"start": s, "kind": k, "end": e, "sha": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in base + wide] for base, wide in found], kind),
        )


def ownership(candidates: DataFrame) -> DataFrame:
    """(sha, n_repos, n_owners) of candidate rows (sha, owner, repo); hot hashes shrink before each exchange."""
    by_repo = candidates.select("sha", "owner", "repo").distinct()
    by_owner = by_repo.groupBy("sha", "owner").agg(F.count(F.lit(1)).alias("repos"))
    repos = by_repo.select("sha", "repo").distinct().groupBy("sha").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = by_owner.groupBy("sha").agg(F.count(F.lit(1)).alias("n_owners"))
    return owners.join(repos, "sha")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", shared_owners: int = 2, shared_repos: int = 8) -> DataFrame:
    """One row per document: the counts and spans, and how its candidates are owned.

    ``n_shared`` counts the candidates that ``shared_owners`` or more owners hold, or one
    owner in ``shared_repos`` or more repositories; ``n_live`` the others; ``max_repos`` is
    the most repositories of any.
    """
    d = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"),
    )
    found = d.mapInArrow(_scan, "doc_id long, owner string, repo string, counts array<long>, base string, cand array<struct<start:long,kind:int,end:long,sha:string>>")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    cand = found.filter(F.size("cand") > 0).select("row", "owner", "repo", F.explode("cand").alias("c")).select("row", "owner", "repo", "c.*")
    freq = ownership(cand)
    marked = cand.join(freq, "sha")  # adaptive execution splits the partition of a hot value
    live = (F.col("n_owners") < shared_owners) & (F.col("n_repos") < shared_repos)
    span = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.col("start"), F.col("end"))
    kept = (F.col("kind") < 3) | live
    by_doc = marked.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(kept, F.struct("start", "kind", span.alias("span"))))).alias("kept"),
        F.sum(F.when(live, 1).otherwise(0)).cast("long").alias("n_live"),
        F.sum(F.when(live, 0).otherwise(1)).cast("long").alias("n_shared"),
        F.max("n_repos").alias("max_repos"),
    )
    zero = F.lit(0).cast("long")
    return found.select("row", "doc_id", "counts", "base").join(by_doc, "row", "left").select(
        "doc_id",
        F.col("counts")[0].alias("n_assign"),
        F.col("counts")[1].alias("n_access"),
        F.col("counts")[2].alias("n_hex"),
        F.sha2(F.col("base"), 256).alias("base_sha256"),
        F.coalesce(F.array_join(F.transform("kept", lambda x: x["span"]), ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_shared", zero).alias("n_shared"),
        F.coalesce("max_repos", zero).alias("max_repos"),
    )
