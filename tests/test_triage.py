from pathlib import Path

import pytest

from chatsieve.plans.lexicon import compile_json, compile_lexicon
from chatsieve.plans.triage import triage, triage_report
from chatsieve.sources.lexicon import dialect_from_documents, lexicon_from_documents

LEXICON = (Path(__file__).parent / "fixtures" / "lexicon_ar.json").read_text(encoding="utf-8")

# text -> (reason, decision)
CASES = [
    ("x" * 5001, "too_long", "ignore"),
    ("قصير", "invalid_input", "ignore"),
    ("كلمةواحدةطويلةجدا", "too_few_words_1", "ignore"),
    ("محتاج بحث 😀 1 😀 2 😀 3 😀 4 😀 5 😀", "too_many_emojis_6", "ignore"),
    ("this is plain english text", "low_arabic_ratio", "ignore"),
    ("محتاج abcdefghi jklmnop qrstuvw xyz", "non_arabic", "ignore"),
    ("اتصل بنا على الرقم ٠٥٥١٢٣٤٥٦٧ ااااااا www.a www.b", "spam_detected", "ignore"),
    ("كيف تستطيع ان اربح المال بسرعه", "spam_pattern", "ignore"),
    ("اسمع هذه نكته جديده اليوم", "ignore_pattern", "ignore"),
    ("راسلني على الرابط wa.me هنا", "ad_blocker", "ignore"),
    ("محتاج بحث وقد تم الحل شكرا", "resolution_phrase: تم الحل", "ignore"),
    ("محتاج بحث ثم لا داعي شكرا", "post_clause_negator: لا داعي", "ignore"),
    ("مكتب خدمات طلابيه تواصل اتصل راسلنا للحجز", "provider_detected", "ignore"),
    ("عندنا خصم على كل الكتب اليوم", "advertisement", "ignore"),
    ("صباح الخير يا جماعه اليوم", "no_keyword", "ignore"),
    ("انا محتاج بحث ضروري اليوم", "keyword_found", "accept"),
    ("انا محتاج بحث ضروري اليوم", "duplicate", "ignore"),
    # negated (0.6): the clause boundary comes after the negator, not before it
    ("مش عارف اذاكر بس محتاج واجب", "keyword_found", "ignore"),
    ("محتاج واجب اليوم يا جماعه", "keyword_found", "review"),
    ("ابي احد يشرح لي الدرس", "keyword_found", "accept"),
    ("ممكن مساعده في الدرس يا اخوان", "indirect_request", "ignore"),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(CASES)]
    msgs = spark.createDataFrame(rows, "id int, text string")
    return triage(msgs, compile_json(LEXICON), ["id"], ["id"]).cache()


def test_every_gate(results):
    got = {r["id"]: (r["reason"], r["decision"]) for r in results.collect()}
    assert got == {i: (reason, decision) for i, (_, reason, decision) in enumerate(CASES)}


def test_scores(results):
    r = results.filter("id = 15").first()
    # legacy 60 + 5 + 15; weighted .3*.9 + .25*.8 + .15 + .15*.8 + .05 + .1/3
    weighted = 0.3 * 0.9 + 0.25 * 0.8 + 0.15 + 0.15 * 0.8 + 0.05 + 0.1 / 3
    assert r["score"] == 80 and abs(r["confidence"] - (0.8 + weighted) / 2 * 0.9) < 1e-9
    assert r["reasons"] == ["intent_verb: محتاج", "academic_object: بحث", "urgency: ضروري"]


def test_report(results):
    r = triage_report(results).first()
    assert (r["messages"], r["duplicates"], r["spam"], r["accepted"], r["reviewed"]) == (len(CASES), 1, 2, 2, 1)


def test_partitioning_does_not_change_results(spark, results):
    rows = [(i, t) for i, (t, _, _) in reversed(list(enumerate(CASES)))]
    again = triage(spark.createDataFrame(rows, "id int, text string").repartition(7), compile_json(LEXICON), ["id"], ["id"])
    key = lambda df: sorted((r["id"], r["reason"], r["confidence"]) for r in df.collect())
    assert key(again) == key(results)


def test_lexicon_table_compiles_to_the_same_sets(spark):
    docs = spark.createDataFrame([(LEXICON,)], "doc string")
    direct, via_table = compile_json(LEXICON), compile_lexicon(lexicon_from_documents(docs))
    for name, terms in direct.sets.items():
        if name != "boost":
            assert via_table.sets[name] == terms, name
    assert via_table.intent_weights == direct.intent_weights
    assert {r["variant"]: r["canonical"] for r in dialect_from_documents(docs).collect()} == direct.dialect


def test_whole_texts_are_scanned(spark):
    text = "كلمه " * 220 + "محتاج بحث"
    msgs = spark.createDataFrame([(1, text)], "id int, text string")
    assert triage(msgs, compile_json(LEXICON), ["id"], ["id"]).first()["reason"] == "keyword_found"
