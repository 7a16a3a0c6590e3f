"""An inverted index in segments: rows come and go without a rebuild.

Every addition is an immutable segment with a number: its rows, which are numbered, with
their lengths, and its postings in runs sorted by term (``operators.index.runs_of``). A
posting is written where its row lies and carries the row's number, so an addition
shuffles no postings. A deletion is a bit for each row that it hides, in bitmaps by
segment and range of row numbers; a row that is added anew is first hidden where it was.
Bitmaps are broadcast, so postings stay where they are as well when hidden ones are left
out. Statistics are rows that add up: a segment brings its rows and tokens, a deletion
takes away what it hides. A merge writes the live postings of the oldest segments to one
folder. All of it is published in versions (``sources.snapshots``), so a search sees
whole segments with their statistics.

Null keys are left out, of equal keys in one addition one row counts, null texts are
empty; scores are those of an index built anew from the live rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators.index import BUCKETS, bags_of, hit_scores, runs_of, wanted_terms
from quarry.operators.lexical import Expression
from quarry.session import delete, new_path
from quarry.sources.snapshots import Snapshots

#: Bitmaps (4 KB for a range of 32,768 rows) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BITMAPS = 20_000
#: Pages are small, so that their statistics tell terms apart.
WRITER = {"compression": "zstd", "parquet.page.row.count.limit": "2000"}


class Segments:
    """The index at a path; the settings are those of its first use. ``buckets`` is noted only: postings lie in runs."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str] | None = None, fold: bool = True, stemmed: bool = False, buckets: int = BUCKETS):
        self.spark, self.store, self._scratch = spark, Snapshots(spark, path), []
        held = self.store.pointer()["notes"].get("settings")
        self.settings = held or {"columns": columns or {"text": "text"}, "fold": fold, "stemmed": stemmed, "buckets": buckets}

    def _table(self, base: dict, name: str) -> DataFrame | None:
        return self.store.frame(base["tables"][name]) if name in base["tables"] else None

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """df, written until the next version is there."""
        path = new_path(self.spark, name)
        self._scratch.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _publish(self, tables: dict[str, DataFrame], **how) -> int:
        version = self.store.publish(tables, options=WRITER, **how)
        while self._scratch:
            delete(self.spark, self._scratch.pop())
        return version

    def _live(self, base: dict, rows: DataFrame) -> DataFrame:
        """Rows (seg, row, and more) that no bitmap hides."""
        hidden = self._table(base, "tombstones")
        if hidden is None:
            return rows
        bits = hidden.groupBy(F.col("seg").alias("_seg"), F.col("part").alias("_part")).agg(F.bitmap_or_agg("bits").alias("_bits"))
        few = base["notes"].get("tombstones", 0) <= BROADCAST_BITMAPS
        joined = rows.join(F.broadcast(bits) if few else bits, (F.col("seg") == F.col("_seg")) & (F.bitmap_bucket_number("row") == F.col("_part")), "left")
        byte = F.conv(F.hex(F.substring("_bits", F.floor(F.bitmap_bit_position("row") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.get(F.array(*(F.lit(1 << k) for k in range(8))), (F.bitmap_bit_position("row") % 8).cast("int"))
        return joined.where(F.col("_bits").isNull() | (byte.bitwiseAND(bit) == 0)).select(*rows.columns)

    def _hide(self, base: dict, keys: DataFrame) -> dict[str, DataFrame]:
        """Bitmaps of those live rows that have one of the keys, and what they take away."""
        rows = self._table(base, "rows")
        if rows is None:
            return {}
        gone = self._written(self._live(base, rows).join(keys.select("key"), "key", "left_semi").select("seg", "row", "len"), "hidden")
        facts = gone.groupBy().agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("total"))
        bits = gone.groupBy("seg", F.bitmap_bucket_number("row").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
        return {"tombstones": self._written(bits, "bitmaps"), "facts": facts}

    def _bags(self, rows: DataFrame, key: str) -> DataFrame:
        """Numbered bags of rows; of equal keys the first number stays."""
        bags = bags_of(rows.where(F.col(key).isNotNull()), key, self.settings["columns"], self.settings["fold"])
        bags = self._written(bags.withColumn("row", F.monotonically_increasing_id()), "bags")
        # Keys alone are shuffled to find equal ones.
        equal = self._written(bags.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("_row")).where("n > 1").select(F.col("key").alias("_key"), "_row"), "equal")
        if equal.isEmpty():
            return bags
        one = bags.join(equal, F.col("key") == F.col("_key"), "left").where("_row is null or row = _row").select(*bags.columns)
        return self._written(one, "bags")

    def keys_of(self, docs: DataFrame) -> DataFrame:
        """The stored keys ``doc:…`` of documents (doc), for rows that are parts of them."""
        rows = self._table(self.store.pointer(), "rows")
        if rows is None:
            return docs.select(F.col("doc").alias("key")).limit(0)
        return rows.withColumn("doc", F.substring_index("key", ":", 1)).join(docs.distinct(), "doc", "left_semi").select("key")

    def add(self, rows: DataFrame, key: str, note: dict | None = None, replaced: DataFrame | None = None) -> int:
        """Add rows as a segment, in the place of those with equal keys and of the keys ``replaced``; returns the version.

        ``note`` (stream, batch) makes a repeated batch do nothing.
        """
        base = self.store.pointer()
        seen = base["notes"].get("batches", {})
        if note and seen.get(note["stream"], -1) >= note["batch"]:
            return base["version"]
        s, number = self.settings, base["notes"].get("last", 0) + 1
        bags = self._bags(rows, key)
        tables = self._hide(base, bags if replaced is None else bags.select("key").union(replaced.select("key")))
        count = lambda d: d.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("total"))
        facts = count(bags) if "facts" not in tables else count(bags).union(tables["facts"])
        tables |= {
            "postings": runs_of(bags, s["columns"], s["stemmed"]).withColumn("seg", F.lit(number).cast("long")),
            "rows": bags.select("key", "len", "row", F.lit(number).cast("long").alias("seg")), "facts": facts.select(F.col("n").cast("long"), F.col("total").cast("long")),
        }
        notes = {"settings": s, "last": number, "segments": [*base["notes"].get("segments", []), number]} | self._counted(base, tables)
        if note:
            notes["batches"] = seen | {note["stream"]: note["batch"]}
        return self._publish(tables, append=tuple(tables), notes=notes, base=base)

    def _counted(self, base: dict, tables: dict[str, DataFrame]) -> dict:
        if "tombstones" not in tables:
            return {}
        return {"tombstones": base["notes"].get("tombstones", 0) + tables["tombstones"].count()}

    def delete(self, keys: DataFrame, key: str = "key") -> int:
        """Hide the rows of some keys; unknown keys change nothing."""
        base = self.store.pointer()
        tables = self._hide(base, keys.select(F.col(key).alias("key")).where("key is not null"))
        if not tables:
            return base["version"]
        tables["facts"] = tables["facts"].select(F.col("n").cast("long"), F.col("total").cast("long"))
        return self._publish(tables, append=tuple(tables), notes=self._counted(base, tables), base=base)

    def merge(self, upto: int | None = None) -> int:
        """Write the live rows of the segments up to a number (all by default) to one folder in the place of theirs; later ones are not touched.

        Rows keep the segment and number that they are known by. A single segment of which nothing is hidden stays.
        """
        base = self.store.pointer()
        numbers = base["notes"].get("segments", [])
        old = [n for n in numbers if upto is None or n <= upto]
        hidden = self._table(base, "tombstones")
        if not old or (len(old) == 1 and (hidden is None or hidden.where(F.col("seg") <= old[-1]).isEmpty())):
            return base["version"]
        tables, behind, number = {}, {}, old[-1]
        for name in ("postings", "rows"):
            held = base["tables"][name]
            tables[name] = self._live(base, self.store.frame(held | {"folders": held["folders"][: len(old)]}))
            behind[name] = held["folders"][len(old) :]
        tables["facts"] = self._table(base, "facts").groupBy().agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        notes = {"segments": [number, *numbers[len(old) :]]}
        if hidden is not None:  # those that hide rows of later segments stay
            tables["tombstones"] = self._written(hidden.where(F.col("seg") > number), "tombstones")
            notes["tombstones"] = tables["tombstones"].count()
        return self._publish(tables, notes=notes, base=base, behind=behind)

    def search(self, expression: Expression, weights: dict[str, float] | None = None, version: int | None = None) -> DataFrame:
        """(key, matched, score) of live rows that satisfy the expression; smaller is better. Only its terms' postings are read."""
        base = self.store.pointer(version)
        if "postings" not in base["tables"]:
            raise ValueError("nothing was added to this index yet")
        spelt = wanted_terms(expression, self.settings["stemmed"])
        hits = self._live(base, self._table(base, "postings").where(F.col("term").isin(sorted(set(spelt.values())))))
        facts = self._table(base, "facts").groupBy().agg(F.sum("n").alias("n"), (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
        return hit_scores(hits, facts.withColumn("mean", F.coalesce("mean", F.lit(0.0))), expression, spelt, weights or {})

    def live_rows(self) -> DataFrame:
        """(key, len) of the rows that a search sees."""
        base = self.store.pointer()
        return self._live(base, self._table(base, "rows")).select("key", "len")
