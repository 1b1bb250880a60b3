"""Personal data and secrets replaced by surrogates of the same kind, with column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsieve.llm.common import fresh, staged

#: Titles and given names by gender. A name is a title or one of these given names, and capitalised words after it.
TITLES = {"m": ("Mr", "Sir", "Monsieur", "Herr", "Señor", "Signor", "Господин", "Κύριος"),
          "f": ("Mrs", "Ms", "Miss", "Madame", "Mademoiselle", "Frau", "Señora", "Signora", "Госпожа", "Κυρία"),
          "n": ("Dr", "Prof", "Professor")}
GIVEN = {"m": ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Andrew",
               "Pierre", "François", "Hans", "Jürgen", "Wolfgang", "Carlos", "Miguel", "Giovanni", "Иван", "Сергей", "Дмитрий", "Алексей", "Γιώργος", "Δημήτρης"),
         "f": ("Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Margaret", "Catherine", "Emily", "Charlotte", "Sophie",
               "Françoise", "Ursula", "Heike", "Carmen", "Lucía", "Giulia", "Мария", "Елена", "Ольга", "Наталья", "Ελένη", "Κατερίνα")}
#: Sixteen syllables for each script; names are made of them, so that there are always more.
SYLLABLES = {"latin": "ba re mi lo du ka se ni vo ru ta le fi no pa mu", "cyrillic": "ба ре ми ло ду ка се ни во ру та ле фи но па му",
             "greek": "βα ρε μι λο δυ κα σε νι βο ρυ τα λε φι νο πα μυ"}
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "l"}, "cyrillic": {"m": "н", "f": "на", "n": "л"}, "greek": {"m": "νος", "f": "να", "n": "λι"}}

_WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
_TITLE = "(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.?\x20" + _WORD + rf"(?:\x20{_WORD}){{0,2}}"
_NAME = "(?:" + "|".join(n for g in GIVEN.values() for n in g) + r")\x20" + _WORD + rf"(?:\x20{_WORD})?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is looked for, in this order at each place. Each alternative begins where no longer run of its own letters does, so time stays linear.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ASSIGNED = r"""(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9+/_.-]{8,}"""
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
PHONE = r"(?<![\w+.-])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{3}\)|\d{3})[\x20.-]\d{3}[\x20.-]\d{4}(?!\d)"
ADDRESS = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w.+-])\d(?:[\x20-]?\d){12,18}(?!\w)"
FOUND = "|".join((EMAIL, ASSIGNED, ACCESS_KEY, f"(?=[0-9+(])(?:{PHONE}|{ADDRESS}|{SOCIAL}|{CARD})",
                  rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}|{_NAME})(?!\p{{L}})"))
_NAMED = r"(?=\p{Lu})(?<!\p{L})(?:" + "|".join(x for words in (*TITLES.values(), *GIVEN.values()) for x in words) + ")"


def _has_entity(text: Column) -> Column:
    """Whether FOUND occurs. Plain tests that each kind of entity needs come first, as most texts fail all of them."""
    likely = (text.contains("@") | text.contains("AKIA") | text.rlike(r"[0-9][0-9\x20().-]{5}")
              | text.rlike(r"""[=:]\s{0,3}["']?[A-Za-z0-9+/_.-]{8}""") | text.rlike(_NAMED))
    return likely & text.rlike(FOUND)


def _in(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column, last_doubled: bool) -> Column:
    """Luhn sum of a digit string; last_doubled: for the digits before a check digit."""
    n = F.length(digits)
    value = F.transform(F.split(digits, ""), lambda c, i: F.when(
        F.pmod(n - i, F.lit(2)) == (1 if last_doubled else 0), F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x)


def _pieces(mention: Column) -> Column:
    """Entities of a mention in their order: struct(kind, own: canonical form, piece). Pieces of kind null stay as they are.

    A phone number is its last ten digits, whatever its punctuation; an e-mail address has no case; a name is its words, so that 'Mr X' and
    'Y X' share a surname.
    """
    def one(kind: str, own: Column, piece: Column, before: Column | None = None) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), own.alias("own"), piece.alias("piece"))
        kept = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("own"), (F.lit("") if before is None else before).alias("piece"))
        return F.array(row) if before is None else F.array(kept, row)

    value = F.regexp_extract(mention, r"[A-Za-z0-9+/_.-]{8,}$", 0)
    head = F.regexp_replace(mention, r"[A-Za-z0-9+/_.-]{8,}$", "")
    by_title = F.coalesce(*(F.when(mention.rlike(rf"^(?:{'|'.join(words)})\.?\x20"), F.lit(g)) for g, words in TITLES.items()), F.lit(""))
    by_name = F.coalesce(*(F.when(mention.rlike(rf"(?:^|\x20)(?:{'|'.join(words)})\x20"), F.lit(g)) for g, words in GIVEN.items()), F.lit("n"))
    gender = F.when(by_title.isin("m", "f"), by_title).otherwise(by_name)
    titled = by_title != ""
    script = lambda w: F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    words = F.split(mention, " ")
    last = F.size(words) - 1
    name = F.transform(words, lambda w, i: F.struct(
        F.when(~(titled & (i == 0)), F.concat(F.when(i == last, "surname").otherwise(F.concat(F.lit("given "), gender)), F.lit(" "), script(w))).alias("kind"),
        F.lower(w).alias("own"), F.concat(F.when(i > 0, " ").otherwise(""), w).alias("piece")))
    digits = _digits(mention)
    return (F.when(_in(mention, EMAIL), one("email", F.lower(mention), mention))
            .when(_in(mention, ASSIGNED), one("secret", value, value, head))
            .when(_in(mention, ACCESS_KEY), one("key", mention, mention))
            .when(_in(mention, PHONE), one("phone", F.right(digits, F.lit(10)), mention))
            .when(_in(mention, ADDRESS), one("address", mention, mention))
            .when(_in(mention, SOCIAL), one("social", digits, mention))
            .when(_in(mention, CARD), F.when(_luhn(digits, False) % 10 == 0, one("card", digits, mention)))
            .otherwise(name))


def _surrogate(key: str) -> Column:
    """The surrogate of (kind, own) at its `attempt`, in canonical form: made of a keyed hash, so it can't be undone without the key."""
    kind, own = F.col("kind"), F.col("own")
    h = F.sha2(F.concat_ws("\x00", F.lit(key), kind, own, F.col("attempt").cast("string")).cast("binary"), 256)
    h = F.concat(h, F.sha2(F.concat(h, F.lit("+")).cast("binary"), 256))
    digits, letters = F.translate(h, "abcdef", "258147"), F.translate(h, "0123456789abcdef", "bcdfghkmnprstvwz")

    def letterwise(text: Column) -> Column:
        """Digit for digit, letter for letter of its case (hexadecimal ones stay so); all else stays."""
        plain = text.rlike("^[0-9a-f]+$")
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: (
            F.when(c.rlike("[0-9]"), F.substring(digits, F.pmod(i * 7, F.lit(128)) + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.when(plain, F.translate(F.substring(h, F.pmod(i * 7, F.lit(128)) + 1, F.lit(1)), "0123456789", "abcdefabcd"))
                  .otherwise(F.substring(letters, F.pmod(i * 7, F.lit(128)) + 1, F.lit(1))))
            .when(c.rlike("[A-Z]"), F.upper(F.substring(letters, F.pmod(i * 7, F.lit(128)) + 1, F.lit(1)))).otherwise(c))), "")

    def octet(at: int, low: int, span: int) -> Column:
        return (F.pmod(F.conv(F.substring(h, at, 6), 16, 10).cast("int"), F.lit(span)) + low).cast("string")

    local, n = F.substring_index(own, "@", 1), F.length(own)
    body = F.concat(F.substring(own, 1, 1), F.substring(digits, F.lit(1), n - 2))
    script = F.substring_index(kind, " ", -1)

    def spelt(syllables: list[str]) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.col("attempt") + 3), lambda i: F.element_at(
            F.array(*map(F.lit, syllables)), F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int") + 1)), "")

    names = None
    for s, syllables in SYLLABLES.items():
        made = spelt(syllables.split(" "))
        ended = F.concat(made, F.when(kind.startswith("given m"), ENDINGS[s]["m"]).when(kind.startswith("given f"), ENDINGS[s]["f"]).otherwise(ENDINGS[s]["n"]))
        names = F.when(script == s, ended) if names is None else names.when(script == s, ended)
    return (F.when(kind == "email", F.concat(letterwise(local), F.lit("@"), F.substring(letters, 40, 6), F.lit(".example")))
            .when(kind == "secret", letterwise(own))
            .when(kind == "key", F.concat(F.lit("AKIA"), letterwise(F.substring(own, F.lit(5), F.lit(64)))))
            .when(kind == "phone", F.concat(octet(1, 2, 8), F.substring(digits, 8, 2), octet(10, 2, 8), F.substring(digits, 17, 6)))
            .when(kind == "address", F.concat_ws(".", octet(1, 1, 223), octet(7, 0, 256), octet(13, 0, 256), octet(19, 1, 254)))
            .when(kind == "social", F.concat(F.lit("9"), F.substring(digits, 1, 8)))
            .when(kind == "card", F.concat(body, F.pmod(-_luhn(body, True), F.lit(10)).cast("string")))
            .otherwise(names))


def _shaped(piece: Column, kind: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the form of the mention: its punctuation, country code and case."""
    skipped = F.greatest(F.length(_digits(piece)) - F.length(surrogate), F.lit(0))
    numbers = F.array_join(F.transform(F.split(piece, ""), lambda c, i: F.when(
        c.rlike("[0-9]") & (F.length(_digits(F.substring(piece, F.lit(1), i + 1))) > skipped),
        F.substring(surrogate, F.length(_digits(F.substring(piece, F.lit(1), i + 1))) - skipped, F.lit(1))).otherwise(c)), "")
    lead = F.when(piece.startswith(" "), " ").otherwise("")
    bare = F.ltrim(piece)
    return (F.when(kind.isin("phone", "card", "social"), numbers)
            .when(kind.startswith("given") | kind.startswith("surname"),
                  F.concat(lead, F.when((bare == F.upper(bare)) & (F.length(bare) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))))
            .otherwise(surrogate))


def _distinct_surrogates(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """(kind, own, surrogate) for distinct entities; no two of a kind share a surrogate, and none is another entity's own form.

    Of those that collide, the one with the fewest attempts (then the smallest form) keeps its surrogate; the others try again.
    """
    made = staged(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(key)))
    for _ in range(rounds):
        first = made.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "own")).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = (made.join(first, ["kind", "surrogate"]).where(F.struct("attempt", "own") != F.col("first")).select("kind", "own"))
        real = made.join(made.select("kind", F.col("own").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "own")
        again = staged(twice.unionByName(real).distinct().withColumn("again", F.lit(1)))
        if again.isEmpty():
            return made
        made = staged(made.join(again, ["kind", "own"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
                      .drop("again", "surrogate").withColumn("surrogate", _surrogate(key)))
    raise RuntimeError(f"surrogates: {rounds} rounds don't suffice")


def replace_entities(docs: DataFrame, key: str = "chatsieve", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, with every entity in `text_col` replaced; one entity has one surrogate in all texts.

    Entities: e-mail addresses, phone numbers, IPv4 addresses, card numbers (Luhn sum right), social security numbers, access keys, values
    assigned to passwords, tokens and the like, and names after a title or a known given name. Surrogates keep kind, punctuation, length
    and case; names keep script and gender; card numbers keep their first digit and a right Luhn sum; e-mail addresses end in '.example'.
    Texts without entities are not shuffled. Of the others each meets the replacements of its own mentions in a join on the text's hash.

    Null text stays null, empty text empty. Repeated rows and null ids don't matter, as rows aren't told apart by ids. Columns of any name
    stay. Empty table: no rows. Where entities overlap, the one that begins first counts, then the first in the order of `FOUND`.
    """
    text, found = F.col(f"`{text_col}`"), F.lit(FOUND)
    mine, table = fresh(docs, "text_hash"), fresh(docs, "replacements")
    hashed = F.sha2(text.cast("binary"), 256)
    having = _has_entity(text)
    mentions = staged(docs.where(having).select(hashed.alias("hash"), F.explode(F.array_distinct(F.regexp_extract_all(text, found, F.lit(0)))).alias("mention"))
                      .distinct())
    pieces = (mentions.withColumn("pieces", _pieces(F.col("mention"))).where("pieces is not null")
              .select("hash", "mention", F.posexplode("pieces").alias("at", "x")).select("hash", "mention", "at", "x.*"))
    known = _distinct_surrogates(pieces.where("kind is not null").select("kind", "own").distinct(), key)
    named = pieces.where("kind is not null").join(known.select("kind", "own", "surrogate"), ["kind", "own"])
    parts = (named.select("hash", "mention", "at", _shaped(F.col("piece"), F.col("kind"), F.col("surrogate")).alias("new"))
             .unionByName(pieces.where("kind is null").select("hash", "mention", "at", F.col("piece").alias("new"))))
    whole = (parts.groupBy("hash", "mention").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("all"))
             .select("hash", "mention", F.array_join(F.col("all.new"), "").alias("new")))
    by_text = staged(whole.groupBy(F.col("hash").alias(mine)).agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias(table)))

    with_map = docs.where(having).withColumn(mine, hashed).join(by_text, mine, "left")
    new = F.transform(F.regexp_extract_all(text, found, F.lit(0)), lambda m: F.coalesce(F.element_at(F.col(table), m), m))
    between = F.split(text, FOUND, -1)
    put = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = with_map.withColumn(text_col, F.when(F.col(table).isNull(), text).otherwise(put)).select(*[f"`{c}`" for c in docs.columns])
    return docs.where(~having | text.isNull()).unionByName(changed)
