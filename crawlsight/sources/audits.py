"""A store of audits: versions of a site's crawl, their differences and scores.

A version's index has a row per page: a digest of what was fetched, and the version whose parse
holds it. A new crawl is compared with the last index by digests alone; only added and changed
pages are parsed, and the rest point to an earlier parse. All is in Parquet folders:

``index/version=N`` (key, digest, parsed_in; the key is the URL unless told otherwise), ``parsed/version=N`` (the parsed crawl's rows that
are new in N), ``context/version=N`` (the site's context) and ``scores/version=N``.

The index is written last and makes a version exist. A job that dies before leaves folders that
the next attempt overwrites, so a lost driver or executor costs the attempt and no version. One
writer at a time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import Site, site
from ..schemas import FETCHED
from .pages import crawl_table, fetched
from .storage import children

#: Columns of a fetch that don't make a page another page.
PASSING = ("crawl_time_s",)


def digest(pages: DataFrame, key: str = "url") -> DataFrame:
    """(key, digest) of fetched pages: everything that was fetched but for the time it took."""
    kept = [f.name for f in StructType.fromDDL(FETCHED).fields if f.name not in (key, *PASSING)]
    # Lengths keep neighbouring columns apart; null differs from empty.
    parts = [F.concat_ws(":", F.coalesce(F.length(c).cast("string"), F.lit("-")), F.coalesce(c, F.lit(""))) for c in kept]
    return pages.select(key, F.sha2(F.concat(*parts), 256).alias("digest"))


class AuditStore:
    """Audits of one site under ``path``, a folder that the driver and all executors share.

    ``key`` is the column that tells pages apart: their URL, or an id where several pages have one URL.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "url"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _table(self, name: str, version: int) -> str:
        return f"{self.path}/{name}/version={version}"

    def _read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self._table(name, version))

    def versions(self) -> list[int]:
        """The versions that exist, in order."""
        names = [n for n in children(self.spark, f"{self.path}/index") if n.startswith("version=")]
        done = [n for n in names if "_SUCCESS" in children(self.spark, f"{self.path}/index/{n}")]
        return sorted(int(n.removeprefix("version=")) for n in done)

    def _known(self, version: int) -> int:
        if version not in self.versions():
            raise ValueError(f"there is no version {version} under {self.path}")
        return version

    def add(self, pages: DataFrame, context: DataFrame | None = None) -> int:
        """Store a crawl of fetched pages, whose keys are unique, as the next version; returns its number."""
        before = self.versions()
        version = before[-1] + 1 if before else 1
        pages = fetched(pages)
        now = digest(pages, self.key)
        if before:
            old = self._read("index", before[-1]).select(self.key, F.col("digest").alias("old"), F.col("parsed_in").alias("was"))
            now = now.join(old, self.key, "left")
        else:
            now = now.select("*", F.lit(None).cast("string").alias("old"), F.lit(None).cast("int").alias("was"))
        same = F.col("old").eqNullSafe(F.col("digest"))
        index = now.select(self.key, "digest", F.when(same, F.col("was")).otherwise(version).alias("parsed_in"))
        # Digests are taken once; the wide pages meet only the narrow list of those to parse.
        index.write.mode("overwrite").parquet(self._table("pending", version))
        pending = self._read("pending", version)
        wanted = pending.where(F.col("parsed_in") == version).select(self.key)
        crawl_table(pages.join(wanted, self.key, "left_semi")).write.mode("overwrite").parquet(self._table("parsed", version))
        if context is not None:
            context.write.mode("overwrite").parquet(self._table("context", version))
        pending.write.mode("overwrite").parquet(self._table("index", version))
        return version

    def index(self, version: int) -> DataFrame:
        return self._read("index", self._known(version))

    def changes(self, old: int, new: int) -> DataFrame:
        """(key, change) of each page of two versions: added, gone, changed or same."""
        a = self.index(old).select(self.key, F.col("digest").alias("a"))
        b = self.index(new).select(self.key, F.col("digest").alias("b"))
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "same").otherwise("changed")
        return a.join(b, self.key, "full").select(self.key, change.alias("change"))

    def crawl(self, version: int) -> DataFrame:
        """The parsed crawl of a version, from the parses that its index points to."""
        index = self.index(version).select(self.key, "parsed_in")
        parts = [r.parsed_in for r in index.select("parsed_in").distinct().orderBy("parsed_in").collect()]  # at most one per version
        out = None
        for part in parts:
            own = index.where(F.col("parsed_in") == part).select(self.key)
            rows = self._read("parsed", part).join(own, self.key, "left_semi")
            out = rows if out is None else out.unionByName(rows)
        return self._read("parsed", version).limit(0) if out is None else out

    def site(self, version: int, **tables: DataFrame) -> Site:
        """The stored crawl with its context, as checks take it."""
        known = "version=%d" % self._known(version) in children(self.spark, f"{self.path}/context")
        return site(self.crawl(version), self._read("context", version) if known else None, **tables)

    def record(self, version: int, name: str, health_score: int, audit_ts: datetime) -> None:
        """Keep the score of a version's audit."""
        row = self.spark.createDataFrame([(name, audit_ts, health_score)], "site string, audit_ts timestamp, health_score int")
        row.coalesce(1).write.mode("overwrite").parquet(self._table("scores", self._known(version)))

    def history(self) -> DataFrame:
        """(site, audit_ts, health_score, version) of recorded audits, as ``health.trend`` takes it."""
        if not children(self.spark, f"{self.path}/scores"):
            return self.spark.createDataFrame([], "site string, audit_ts timestamp, health_score int, version int")
        return self.spark.read.parquet(f"{self.path}/scores")
