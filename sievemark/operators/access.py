"""Admission of sources to an analysis under a budget of files and bytes, and pages of source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EvidenceError
from .budget import numbered, retained, running_sum

FILES, BYTES, SOURCE_BYTES = 200, 32 << 20, 5 << 20
#: Sources that the driver sees at a time at most, as paths and sizes.
LISTED = 10_000


def admit(sources: DataFrame, on_budget: str = "skip", max_bytes: int = BYTES, max_files: int = FILES, source_bytes: int = SOURCE_BYTES, key: str | None = None) -> DataFrame:
    """``path, size, status``: what a budget lets through, in the order of paths.

    ``skip`` leaves out a source that doesn't fit and goes on; ``sticky`` makes everything after the first such source
    unavailable; ``stop`` returns only what comes before it.  Sources above ``source_bytes`` are skipped in each case
    but ``sticky``, where they use the budget up.  ``skip`` is a fold, by ``key`` in the task of the key; without one see
    :func:`admitted_paths`.
    """
    rows = sources.select(*([key] if key else []), "path", "size")
    if on_budget == "skip":
        near = rows.where(F.col("size") <= source_bytes)
        if key:
            kept = retained(near, "size", ["path"], key, max_bytes, max_files).select("path", F.lit("admitted").alias("status"))
        else:
            kept = rows.sparkSession.createDataFrame([(p, "admitted") for p in admitted_paths(near, max_bytes, max_files)], "path string, status string")
            kept = F.broadcast(kept) if max_files <= LISTED else kept
        return rows.join(kept, "path", "left").select(*([key] if key else []), "path", "size", F.coalesce("status", F.lit("unavailable")).alias("status"))
    if on_budget not in ("sticky", "stop"):
        raise EvidenceError("on_budget is skip, sticky or stop", "E_BUDGET")
    near = rows if on_budget == "sticky" else rows.where(F.col("size") <= source_bytes)
    # A source too large counts as more than any budget, so nothing after it fits.
    size = F.when(F.col("size") > source_bytes, F.lit(max_bytes + 1)).otherwise(F.col("size"))
    counted = near.withColumn("cost_", size.cast("decimal(38,0)") * F.lit(1 << 32) + 1)
    if key:
        w = Window.partitionBy(key).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counted.withColumn("upto_", F.sum("cost_").over(w))
    else:
        summed = running_sum(counted, "cost_", ["path"])
    fits = (F.floor(F.col("upto_") / F.lit(1 << 32)) <= max_bytes) & (F.col("upto_") % F.lit(1 << 32) <= max_files)
    out = summed.select(*([key] if key else []), "path", "size", F.when(fits, F.lit("admitted")).otherwise(F.lit("unavailable")).alias("status"))
    return out if on_budget == "sticky" else out.where("status = 'admitted'")


def admitted_paths(sources: DataFrame, max_bytes: int, max_files: int) -> list[str]:
    """The paths that are admitted, in order, where one that doesn't fit is skipped: at most ``max_files``.

    What is left of the budget only shrinks, so a source larger than that can't follow any more.  Each step asks for
    the next sources that could still fit, one more than may be admitted: a top-k of paths and sizes, which no task
    sorts as a whole and of which the first always is admitted.  So there are at most as many steps as admitted
    sources, and few in practice, as a step ends either all of the files or most of the bytes.
    """
    out: list[str] = []
    after = None
    while max_files > len(out) and max_bytes >= 0:
        left = sources.where(F.col("size") <= max_bytes)
        if after is not None:
            left = left.where(F.col("path") > after)
        most = min(max_files - len(out) + 1, LISTED)
        some = left.orderBy("path").limit(most).collect()
        for row in some:
            if row["size"] <= max_bytes and len(out) < max_files:
                max_bytes -= row["size"]
                out.append(row["path"])
        if len(some) < most:
            break
        after = some[-1]["path"]
    return out


def round_robin(items: DataFrame, tier: str = "tier", key: str = "path", position: str = "position") -> DataFrame:
    """Items by tier, then one of each source in turn, then by source: ``ord`` from 1 within a tier."""
    turns = numbered(items, [tier, key], [position], "turn_")
    return numbered(turns, [tier], ["turn_", key], "ord").withColumn("ord", F.col("ord").cast("int")).drop("turn_")


def visible_history(historic: DataFrame, current_rules_hide: DataFrame) -> DataFrame:
    """Historic paths (``path``) that today's ignore and privacy rules don't hide; explicit globs come after this."""
    return historic.join(current_rules_hide.select("path").distinct(), "path", "left_anti")


def source_page(text: str, focus: int, budget: int) -> tuple[int, int]:
    """A half-open range of code points around a focus whose UTF-8 takes at most ``budget`` bytes.

    It begins as wide as the budget and shrinks by a quarter until it fits.
    """
    width = max(1, min(len(text), budget))
    while True:
        a = max(0, min(focus - width // 2, len(text) - width))
        if width <= 1 or len(text[a : a + width].encode()) <= budget:
            return a, min(len(text), a + width)
        width = max(1, width * 3 // 4)


class Continuations:
    """Pages of one source that go on where the last one ended; only offsets that were given out are taken."""

    def __init__(self, text: str, budget: int = 16_384):
        self.text, self.budget, self.issued = text, budget, {0}

    def page(self, offset: int = 0) -> tuple[str, int | None]:
        if offset not in self.issued:
            raise EvidenceError("the offset was not given out", "E_CURSOR_OFFSET")
        end, used = offset, 0
        while end < len(self.text) and (n := len(self.text[end].encode())) + used <= self.budget:
            used, end = used + n, end + 1
        if end == offset and offset < len(self.text):
            end += 1  # a page makes progress
        following = end if end < len(self.text) else None
        if following is not None:
            self.issued.add(following)
        return self.text[offset:end], following


def own_ranges(functions: DataFrame) -> DataFrame:
    """``path, name, start, end``: the ranges of functions (``path, name, start, end``) without the functions inside.

    Functions are nested, never crossed, so a boundary belongs to the innermost one open there: a stack over the
    sorted boundaries of one source, kept as an array within its row.
    """
    sorted_ = functions.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "name"))).alias("f"))
    children = F.transform(
        "f",
        lambda x: F.struct(
            x["name"].alias("name"), x["start"].alias("start"), (-x["e"]).alias("end"),
            F.filter("f", lambda y: (y["start"] >= x["start"]) & (y["e"] >= x["e"]) & ~((y["start"] == x["start"]) & (y["e"] == x["e"]))).alias("inside"),
        ),
    )
    each = sorted_.select("path", F.explode(children).alias("x")).select("path", "x.*")
    start = F.struct(F.col("start").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc, y):
        free = F.when(y["start"] > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), y["start"].cast("long").alias("end"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], (-y["e"]).cast("long")).alias("at"), free.alias("out"))

    def rest(acc):
        end = F.col("end").cast("long")
        return F.when(acc["at"] < end, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["out"])

    return each.select("path", "name", F.explode(F.aggregate("inside", start, step, rest)).alias("r")).select("path", "name", "r.start", "r.end")
