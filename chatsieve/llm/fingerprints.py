"""Document fingerprints from closed syncmers, with column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsieve.llm.common import staged, texts

#: Words are runs without white space; letters of scripts without spaces stand alone.
WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]+"
#: Words of a k-mer and of the inner s-mers; anchors of a fingerprint; characters that an anchor takes: 8 of hash, 6 of place, hexadecimal.
K, S, ANCHORS, HASH_CHARS, CHARS = 4, 2, 64, 8, 14
SHORT = 12
_PLACES = 1 << 24


def _let(value: Column, then) -> Column:
    """then(value), with `value` computed once although `then` uses it in functions of its own."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fingerprint(text: Column, anchors: int = ANCHORS) -> Column:
    """Fingerprint string of a text: its `anchors` closed syncmers of lowest hash, each with its place (the number of its first word).

    A k-mer of words is a closed syncmer if the least of its s-mers (by hash) is its first or its last. That depends on its own words alone,
    so the same passage yields the same anchors wherever it stands. Of equal syncmers the first counts. In a text of fewer than `SHORT` words
    each word is an anchor; without words, or null, it has none: the empty string. Places beyond 2**24 are written as that number.
    """
    def chosen(w: Column) -> Column:
        n = F.size(w)
        inner = F.transform(F.sequence(F.lit(0), n - S), lambda j: F.xxhash64(*(F.get(w, j + i) for i in range(S))))

        def packed(h: Column) -> Column:
            last = K - S
            found = F.filter(F.sequence(F.lit(0), n - K), lambda i: F.least(F.get(h, i), F.get(h, i + last)) <= F.array_min(F.array(*(F.get(h, i + j) for j in range(1, last)))))
            return F.transform(found, lambda i: _packed(F.xxhash64(*(F.get(w, i + j) for j in range(0, K, S)), *(F.get(h, i + j) for j in (0, last))), i))

        each = F.transform(w, lambda x, i: _packed(F.xxhash64(x), i))
        return F.when(n >= SHORT, _let(inner, packed)).otherwise(each)

    all_ = _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), chosen)
    ordered = _let(F.sort_array(all_), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.floor(x / _PLACES) != F.floor(F.get(a, F.greatest(i - 1, F.lit(0))) / _PLACES))))
    return F.array_join(F.transform(F.slice(ordered, 1, anchors), lambda x: F.lower(F.lpad(F.hex(x), CHARS, "0"))), "")


def _packed(h: Column, place: Column) -> Column:
    """32 bits of hash, then the place: numbers that sort by hash."""
    return F.shiftright(h, 32).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(_PLACES) + F.least(place, F.lit(_PLACES - 1))


def likeness(a: Column, b: Column, anchors: int = ANCHORS, slack: int = 8) -> Column:
    """Likeness of two fingerprints, 0 to 1: an estimate of the share of anchors that both texts have in the same order.

    Anchors are compared up to the hash to which both fingerprints are complete. Of the common ones those count whose shift in place is near
    the median shift (within `slack` words, or a sixteenth of the text). Equal fingerprints: 1. A fingerprint without anchors is like
    another without anchors (1) and unlike all others (0). Null counts as without anchors.
    """
    def entries(fp: Column) -> Column:
        n = F.floor(F.length(fp) / CHARS).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            F.substring(fp, i * CHARS + 1, F.lit(HASH_CHARS)).alias("h"),
            F.conv(F.substring(fp, i * CHARS + 1 + HASH_CHARS, F.lit(CHARS - HASH_CHARS)), 16, 10).cast("int").alias("p")))
        ).otherwise(F.array().cast("array<struct<h:string,p:int>>"))

    def limit(x: Column) -> Column:
        return F.when(F.size(x) >= anchors, F.element_at(x, -1)["h"]).otherwise(F.lit("g"))

    def rate(z: Column) -> Column:
        x, y = z["x"], z["y"]

        def upto(top: Column) -> Column:
            both = F.struct(F.filter(x, lambda e: e["h"] <= top).alias("x"), F.filter(y, lambda e: e["h"] <= top).alias("y"))
            return _let(both, within)

        return _let(F.least(limit(x), limit(y)), upto)

    def within(z: Column) -> Column:
        x, y = z["x"], z["y"]
        places = F.map_from_entries(y)
        shifts = _let(places, lambda m: F.sort_array(F.filter(F.transform(x, lambda e: F.element_at(m, e["h"]) - e["p"]), lambda d: d.isNotNull())))

        def counted(d: Column) -> Column:
            n = F.size(d)
            middle = F.element_at(d, F.floor(n / 2).cast("int") + 1)
            widest = F.greatest(F.lit(slack), F.floor(F.array_max(F.transform(x, lambda e: e["p"])) / 16))
            good = _let(F.struct(middle.alias("m"), widest.alias("w")), lambda c: F.size(F.filter(d, lambda v: F.abs(v - c["m"]) <= c["w"])))
            return F.when(n > 0, good / (F.size(x) + F.size(y) - n)).otherwise(F.lit(0.0))

        return _let(shifts, counted)

    fa, fb = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(fa == fb, F.lit(1.0)).when((fa == "") | (fb == ""), F.lit(0.0)).otherwise(
        _let(F.struct(entries(fa).alias("x"), entries(fb).alias("y")), rate))


def with_next(rows: DataFrame, columns: list[str], bucket_rows: int = 512, cells: int = 1024, derive=lambda df: df) -> DataFrame:
    """`rows` (doc_id, ...) with next_<c> for each c of `columns`: its value in the next row in descending doc_id order; after the last, the first.

    derive: makes columns that `rows` doesn't have yet; it is applied where they are needed, so not to rows that a join leaves out.

    Ids are cut into at most `cells` ranges of equal width, ranges with too many rows into narrower ones; each range is a window of its own,
    whose last row takes its successor from the first row of the next range. So no task holds more than some ranges, and what all ranges
    give together is one row each. Null ids come last; rows with one id in the order of `columns`.
    """
    bounds = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high, n = bounds[0] or 0, bounds[1] or 0, bounds[2]
    width = max(1.0, (high - low + 1) / max(1, min(cells, n // bucket_rows)))
    most = max(2 * bucket_rows, n // (4 * cells))
    cell = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / width), F.lit(-1))
    ranges = staged(rows.groupBy(cell.alias("_cell")).agg(F.min("doc_id").cast("double").alias("_from"), F.max("doc_id").cast("double").alias("_to"),
                                                          F.ceil(F.count("*") / most).alias("_parts")))
    part = F.least(F.col("_parts") - 1, F.floor((F.col("doc_id").cast("double") - F.col("_from")) * F.col("_parts") / (F.col("_to") - F.col("_from") + 1)))
    # at most `cells` ranges and two more
    placed = (derive(rows).withColumn("_cell", cell).join(F.broadcast(ranges), "_cell")
              .withColumn("_range", F.col("_cell") * (1 << 24) + F.coalesce(part, F.lit(0))).drop("_cell", "_from", "_to", "_parts"))
    by_id = [F.desc_nulls_last("doc_id"), *columns]
    inside = Window.partitionBy("_range").orderBy(*by_id)
    heads = staged(placed.select("_range", "doc_id").groupBy("_range").agg(F.max("doc_id").alias("_head")))
    around = Window.orderBy(F.desc("_range"))
    after = (heads.withColumn("_then", F.lead("_range").over(around))
             .select(F.coalesce("_then", F.lit(heads.agg(F.max("_range")).first()[0])).alias("_then"), F.col("_range").alias("_before")))
    at_heads = staged(rows.join(heads, F.col("doc_id").eqNullSafe(F.col("_head"))))  # one row per range, unless ids repeat
    first = derive(at_heads).groupBy("_range").agg(F.min(F.struct(*columns)).alias("_first"))
    tails = after.join(first, F.col("_then") == F.col("_range")).select(F.col("_before").alias("_range"), "_first")
    led = placed.withColumns({f"next_{c}": F.lead(c).over(inside) for c in columns} | {"_more": F.lead(F.lit(1)).over(inside)})
    return led.join(tails, "_range", "left").withColumns(
        {f"next_{c}": F.when(F.col("_more").isNull(), F.col(f"_first.{c}")).otherwise(F.col(f"next_{c}")) for c in columns}).drop("_range", "_more", "_first")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited (its last third replaced by as much of the next document's beginning), fingerprint,
    edited_fingerprint, near_edited, near_next.

    Null text: the empty text. Null and repeated ids: see `with_next`; each row has a result. One row alone is its own next. Empty table: no rows.
    """
    both = with_next(texts(docs, id_col, text_col), ["text", "fingerprint"],
                     derive=lambda rows: rows.withColumn("fingerprint", fingerprint(F.col("text"))))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    made = both.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return made.select("doc_id", n.cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
