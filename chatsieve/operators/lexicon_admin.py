"""Lexicon maintenance: index, search, edits, replace and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.config import DEFAULT_TERM_WEIGHT
from chatsieve.functions.text import let, strip_ws
from chatsieve.operators import ordered as O


def lexicon_index(lexicon: DataFrame) -> DataFrame:
    """One row per list: category, its number of terms, path, label, count and items of the list, in document order."""
    lists = lexicon.groupBy("category", "path").agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("count"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda r: r["term"]).alias("items"))
    label = F.when(F.col("path") == F.col("category"), "(main list)").otherwise(
        F.substring("path", F.length("category") + 2, F.length("path")))
    totals = lexicon.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    return lists.join(totals, "category").withColumn("label", label).orderBy("ord", "path").select(
        "category", "total", "path", "label", "count", "items")


def lexicon_search(lexicon: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(path, term) of terms containing the query, case ignored, in document order."""
    needle = query.strip().lower()
    if not needle:
        return lexicon.limit(0).select("path", "term")
    hits = lexicon.filter(F.contains(F.lower("term"), F.lit(needle)))
    ordered = hits.orderBy("ord", "path", "pos")
    return (ordered if limit is None else ordered.limit(limit)).select("path", "term")


def apply_lexicon_edits(lexicon: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new lexicon, statuses) after edits (path, action, old, new, seq), taken in seq order.

    Statuses: ok, empty, bad_path, already_exists, not_found. An added term comes last in its list; a renamed one keeps its place; of a
    term that stands several times in a list the first one is renamed or deleted. The lexicon given stays as it is, so the old version is kept.

    Only terms that edits touch are looked at. The edits of one term stream through a task by themselves; those that renames tie
    together, per list. No list is held: what remains of all lists is numbered anew, in chunks.
    """
    lists = lexicon.groupBy("path").agg(
        F.first("category").alias("category"), F.first("grp").alias("grp"), F.first("weight").alias("weight"), F.min("ord").alias("ord"))
    asked = edits.select("path", "seq", "action", "old", strip_ws(F.coalesce("new", F.lit(""))).alias("value")).join(
        lists.select("path", F.lit(True).alias("_known")), "path", "left")
    early = F.when((F.col("action") != "delete") & (F.col("value") == ""), "empty").when(F.col("_known").isNull(), "bad_path").when(
        (F.col("action") != "add") & F.col("old").isNull(), "not_found")
    judged = asked.withColumn("status", early)
    open_ = judged.filter(F.col("status").isNull())
    named = F.when(F.col("action") == "add", F.array("value")).when(F.col("action") == "delete", F.array("old")).otherwise(F.array("old", "value"))
    tied = open_.filter(F.col("action") == "rename").select("path", F.explode(named).alias("term")).distinct()
    first = open_.withColumn("term", named[0]).join(tied.withColumn("_tied", F.lit(True)), ["path", "term"], "left")
    # the terms of a list that renames tie together are one unit, any other term is one by itself
    unit = F.when(F.col("_tied").isNotNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("term")))
    steps = first.withColumn("unit", unit)
    touched = steps.select("path", "unit", F.explode(named).alias("term")).distinct()
    seq = edits.schema["seq"].dataType.simpleString()
    nothing = {"pos": "int", "seq": seq, "action": "string", "old": "string", "value": "string", "term": "string"}

    def row(df: DataFrame, given: tuple[str, ...], kind: int) -> DataFrame:
        return df.select("path", "unit", F.lit(kind).alias("kind"), *(
            F.col(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in nothing.items()))

    there = row(lexicon.select("path", "term", "pos").join(touched, ["path", "term"]), ("pos", "term"), 0)
    todo = row(steps, ("seq", "action", "old", "value"), 1)
    ready = there.unionByName(todo).repartition("path", "unit").sortWithinPartitions("path", "unit", "kind", "pos", "seq", "action", "old", "value")
    done = O.stable(ready.mapInArrow(_edit, f"path string, seq {seq}, status string, term string, pos int"))
    statuses = judged.filter(F.col("status").isNotNull()).select("path", "seq", "status").unionByName(
        done.filter(F.col("status").isNotNull()).select("path", "seq", "status"))
    kept = lexicon.join(touched.select("path", "term"), ["path", "term"], "left_anti").select(
        "path", "term", "weight", F.lit(False).alias("added"), F.col("pos").alias("at"), F.lit(None).cast(seq).alias("seq"))
    stays = done.filter(F.col("status").isNull()).select(
        "path", "term", F.lit(None).cast("double").alias("weight"), F.col("pos").isNull().alias("added"), F.col("pos").alias("at"), "seq")
    placed = O.numbered(kept.unionByName(stays), ["path"], ["added", "at", "seq", "term"], "pos")
    fresh = placed.withColumnRenamed("weight", "own").join(lists, "path").withColumn("weight", F.coalesce("own", "weight"))
    return fresh.select("path", "category", "grp", "term", "weight", F.col("pos").cast("int"), "ord"), statuses


def _edit(batches):
    """Rows of a unit in order: the terms that stand in the list (kind 0), then its edits. Gives a status per edit and what stands at the end."""
    import heapq
    from itertools import groupby

    import pyarrow as pa

    types = None

    def rows():
        nonlocal types
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("path", "seq", "action", "term", "pos")]
            yield from batch.to_pylist()

    def out(made):
        columns = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "seq", "status", "term", "pos"])

    made = []
    for (path, _), unit in groupby(rows(), key=lambda r: (r["path"], r["unit"])):
        places: dict = {}  # term -> heap of its places: those of the list by pos, then those added by seq
        for nr, r in enumerate(unit):
            if r["kind"] == 0:
                heapq.heappush(places.setdefault(r["term"], []), (0, r["pos"], nr, None))
                continue
            action, value = r["action"], r["value"]
            source, target = places.get(r["old"]), places.get(value)
            if action == "add":
                status = "already_exists" if target else "ok"
                if not target:
                    places[value] = [(1, 0, nr, r["seq"])]
            elif not source:
                status = "not_found"
            elif action == "rename" and target and value != r["old"]:
                status = "already_exists"
            else:
                status = "ok"
                place = heapq.heappop(source)
                if action == "rename":
                    heapq.heappush(places.setdefault(value, []), place)
            made.append((path, r["seq"], status, None, None))
        for term, held in places.items():
            made.extend((path, seq, None, term, None if added else pos) for added, pos, _, seq in held)
        if len(made) > 5_000:
            yield out(made)
            made = []
    if made:
        yield out(made)


def export_lexicon(lexicon: DataFrame) -> DataFrame:
    """The lexicon as one JSON document per category, in lines: category, line_no, line. A category's lines in order are its document.

    Lists and members stand in their order, at any depth; every term has a line of its own, and one more line closes the document. A weight
    hint is written where a list's weight isn't the default. No row holds more than a term: a line follows from its row and the row
    before it, so a large category is written chunk by chunk. A path that is a list can't have lists below it.
    """
    lists = lexicon.groupBy("category", "path").agg(F.min("ord").alias("ord"), F.max("weight").alias("hint")).withColumn("parts", F.split("path", r"\."))
    # Members of an object stay together, in the order of the first list below each of them.
    depths = lists.select("path", "ord", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    upto = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), ".")
    firsts = depths.groupBy(upto.alias("above")).agg(F.min("ord").alias("first"))
    place = F.sort_array(F.collect_list(F.struct("depth", F.col("first").alias("at"), F.col("parts")[F.col("depth") - 1].alias("part"))))
    places = depths.withColumn("above", upto).join(firsts, "above").groupBy("path").agg(place.alias("place"))
    rows = lexicon.select("category", "path", "pos", "term").join(lists.select("path", "parts", "hint"), "path").join(places, "path").select(
        "category", F.lit(False).alias("end"), "place", "path", "pos", "term", "parts", "hint")
    ends = lexicon.select("category").distinct().select("category", F.lit(True).alias("end"), *(
        F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("place", "path", "pos", "term", "parts", "hint")))
    order = ["end", "place", "path", "pos", "term"]
    numbered = O.numbered(rows.unionByName(ends), ["category"], order, "line_no")
    # the row before: a self-join on the number, as the rows lie in chunks
    before = numbered.select("category", (F.col("line_no") + 1).alias("line_no"), F.col("parts").alias("last"))
    both = numbered.join(before, ["category", "line_no"], "left")
    return both.select("category", "line_no", _export_line(F.col("last"), F.col("parts"), F.col("term"), F.col("hint")).alias("line"))


def _quoted(text: Column) -> Column:
    """A JSON string. Inside an array, as Spark writes no bare strings as JSON."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _export_line(last: Column, parts: Column, term: Column, hint: Column) -> Column:
    """What comes between the term before (of path `last`, null at the beginning) and this one (`parts`, null at the end), and this term."""
    zero = F.lit(0)
    shared = F.aggregate(
        F.arrays_zip(last.alias("a"), parts.alias("b")), F.struct(zero.alias("n"), F.lit(True).alias("same")),
        lambda acc, x: let(acc["same"] & F.coalesce(x["a"] == x["b"], F.lit(False)), lambda s: F.struct(
            (acc["n"] + F.when(s, 1).otherwise(0)).alias("n"), s.alias("same"))))["n"]
    common = F.when(last.isNull() | parts.isNull(), zero).otherwise(shared)

    def opened(n: Column) -> Column:
        """Objects from the n-th part on, then the list."""
        inner = F.slice(parts, n + 1, F.size(parts) - n - 1)
        objects = F.array_join(F.transform(inner, lambda x: F.concat(_quoted(x), F.lit(": {"))), "")
        name = F.element_at(parts, -1)
        weight = F.when((name == "terms") & hint.isNotNull() & (hint != DEFAULT_TERM_WEIGHT), F.concat(F.lit('"_weight_hint": '), hint.cast("string"), F.lit(", ")))
        return F.concat(objects, F.coalesce(weight, F.lit("")), _quoted(name), F.lit(": ["))

    def closed(n: Column) -> Column:
        return F.concat(F.lit("]"), F.repeat(F.lit("}"), F.size(last) - n - 1))

    return let(common, lambda n: F.when(parts.isNull(), F.concat(closed(zero), F.lit("}")))
               .when(last.isNull(), F.concat(F.lit("{"), opened(zero), _quoted(term)))
               .when(last == parts, F.concat(F.lit(", "), _quoted(term)))
               .otherwise(F.concat(closed(n), F.lit(", "), opened(n), _quoted(term))))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """Text files of the exported documents, a folder for each category: `category=<name>/part-*`, to be read in the order of their names."""
    lines = export_lexicon(lexicon).repartitionByRange("category", "line_no").sortWithinPartitions("category", "line_no")
    lines.select("category", "line").write.mode("errorifexists").partitionBy("category").text(path)


def replace_lexicon(docs: DataFrame, target: str, version: int) -> None:
    """Write the document as a new version; it must be a non-empty JSON object.

    Earlier versions stay in their own folders, so going back is reading one of them.
    """
    keys = F.size(F.json_object_keys("doc"))
    good = docs.filter(F.ltrim("doc").startswith("{") & (F.coalesce(keys, F.lit(0)) > 0))
    if docs.limit(2).count() != 1 or good.isEmpty():
        raise ValueError("a lexicon must be one non-empty JSON object")
    good.select(F.col("doc").alias("value")).coalesce(1).write.mode("errorifexists").text(
        f"{target}/version={version:06d}")
