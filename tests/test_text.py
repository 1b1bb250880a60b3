from chatsieve.config import ARABIC, LATIN, TriageConfig
from chatsieve.operators import text as T


def one(df):
    return df.collect()[0]


def test_arabic_normalization(spark):
    df = spark.createDataFrame([("  أُحِبّ \n القراءةِ  إلى ــ آخِرى ",)], "text string")
    assert one(T.normalize_messages(df, ARABIC))["norm_text"] == "احب القراءه الي  اخري"


def test_dialect_is_single_pass_longest_first_and_bounded(spark):
    mapping = {"wanna": "want to", "wanna be": "become", "want": "need", "x": "wanna"}
    rows = [("wanna wannabe, wanna be x want!",), ("xwanna",), ("x x,x",)]
    df = T.canonicalize_terms(spark.createDataFrame(rows, "norm_text string"), mapping)
    assert [r[0] for r in df.collect()] == ["want to wannabe, become wanna need!", "xwanna", "wanna wanna,wanna"]


def test_signals_and_spam(spark):
    rows = [("call +1 (743) 555-3824 or 743-555-3824 aaaaa https://a.b www.c t.me/x",), ("٠٥٥١٢٣٤٥٦٧ 😀😀 😀 漢字",)]
    out = T.spam_score(T.text_signals(spark.createDataFrame(rows, "text string"), LATIN)).collect()
    assert (out[0]["url_count"], out[0]["has_phone"], out[0]["has_repeat"]) == (3, True, True)
    assert round(out[0]["spam_score"], 6) == 0.85 and out[0]["is_spam"]
    assert (out[1]["has_phone"], out[1]["emoji_runs"]) == (True, 3)
    strict = T.text_signals(spark.createDataFrame(rows[1:], "text string"), LATIN, TriageConfig(strict_emoji=True))
    assert one(strict)["emoji_runs"] == 2


def test_validation_and_card(spark):
    rows = [("x" * 5001,), ("   short   ",), ("long enough text",)]
    out = T.validate_messages(spark.createDataFrame(rows, "text string")).collect()
    assert [r["invalid_reason"] for r in out] == ["too_long", "invalid_input", None]
    card = spark.createDataFrame(
        [(-1001234, 7, 5, None, None, None, None, None, "<b>" + "y" * 500, 25)],
        "chat_id long, message_id long, sender_id long, chat_username string, sender_username string, "
        "sender_first_name string, sender_last_name string, sender_access_hash long, text string, score int")
    r = one(T.alert_card(card, fallback_name="user"))
    assert (r["group_link"], r["message_link"]) == ("https://t.me/c/1234", "https://t.me/c/1234/7")
    assert r["display_name"] == "user (5)" and r["score_bar"] == "[██░░░░░░░░] 25"
    assert r["safe_text"].startswith("&lt;b&gt;y") and r["safe_text"].endswith("...")


def test_patterns_leave_most_characters_alone(spark):
    """Runs of white space that are one space already need no replacement, and few terms no pattern."""
    from pyspark.sql import functions as F

    from chatsieve.functions import matching as M
    from chatsieve.functions import text as X
    odd = [" a b  c\t d\n\n", "  　", "", "a b   c", "one two", None, "x\x1c \x1cy", "﷐th﷑ nd th"]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, t string")
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))

    def collapsed(t):
        out = ""
        for c in t:
            out += (" " if c in spaces else c) if not (c in spaces and out.endswith(" ")) else ""
        return out

    got = df.select("id", X.collapse_ws(F.col("t")).alias("c"), X.share_of(F.col("t"), "a-c").alias("s"),
                    X.replace_terms(F.col("t"), {"th": "the", "nd": "and"}).alias("r"),
                    M.occurs(F.col("t"), ["b", "", "]"]).alias("o")).collect()
    for r in got:
        t = odd[r["id"]]
        if t is None:
            assert (r["c"], r["s"], r["r"], r["o"]) == (None, None, None, None)
            continue
        assert r["c"] == collapsed(t) and r["s"] == sum(c in "abc" for c in t) / max(1, len(t)) and r["o"] == ("b" in t)
    assert [r["r"] for r in got][-1] == "the and the"
    assert "rlike" not in df.select(M.occurs(F.col("t"), ["b", "c"]))._jdf.queryExecution().optimizedPlan().toString().lower()
