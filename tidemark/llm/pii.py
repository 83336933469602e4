"""Surrogates for personal data. DataFrame functions only.

Detected entities are replaced by keyed surrogates of the same type. Found are e-mail addresses, keys of known
forms, secrets and passwords after a word that says so, IPv6 and IPv4 addresses, telephone numbers
(international, and national of ten digits in their usual groups), social security numbers, IBANs with right
check digits, payment cards that pass the Luhn test, and names after a title, with later mentions of the same
full name in that text without one. Other names, and numbers in other layouts, are not found.

An entity is a type and a normal form: case of an address, separators of a number, and the title of a name do
not matter, and each word of a name is an entity of its own (with the title's gender), so ``Mr. Anton Petrov``,
``Mr Petrov`` and ``Anton Petrov`` stay one person, and one card is one card however it is grouped. The
surrogate has the normal form's layout and script; each mention gets it in its own case and separators. Octets
stay octets, cards pass the Luhn test, IBANs have right check digits, names have an ending of their gender.

Distinctness is checked, not hoped for: of the distinct entities of the corpus, those whose surrogates are
equal, or equal one that occurs, are drawn again (all but one of equals) until none are left. From WIDEN rounds
on a layout with too few values gives way to the next larger one of the same type: octets of any width, a
letter, syllable or digit more. What a value becomes thus depends on the key and, where surrogates met, on the
corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, width

#: Rounds in one layout; rounds after which something is wrong, since each round of WIDEN on has at least ten
#: times the values of the one before.
WIDEN, ROUNDS = 3, 40

# Titles by gender, and the pieces that made-up names are built of by script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Madame", "Frau", "Señora", "Госпожа", "Κυρία"], "m": ["Mr", "Sir", "Monsieur", "Herr", "Señor", "Господин", "Κύριος"], "n": ["Dr", "Prof", "Doctor", "Professor"]}
SYLLABLES = {
    "latin": "ba be bi da de di fa fe ga ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te va",
    "cyrillic": "ба бе ви га да де за зи ка ки ла ле ли ма ми мо на не ни но па ра ре ри ро са се та те то ва ве",
    "greek": "βα βε γα δα δε ζα θα θε κα κε λα λε λι μα με μι να νε νι πα ρα ρε ρι σα σε τα τε φα φι χα ψα ξα",
}
ENDINGS = {"latin": {"f": "na lia ria", "m": "nus ron lek", "n": "nes ren lin"}, "cyrillic": {"f": "на лия рина", "m": "нов рин лек", "n": "нис рен лин"}, "greek": {"f": "να λια ρη", "m": "νος ρων λης", "n": "νις ρεν λιν"}}
LETTERS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "other": "àâäçèéêëîïñôöùûü"}

_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_titles = "|".join(sorted((t for g in TITLES.values() for t in g), key=len, reverse=True))
_said = r"(?<=[=:\s\"'])(?<=(?i:token|secret|password|passwd|pwd|key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
#: What is found, in this order where two could begin at the same place; what begins first comes first, and
#: the next is looked for behind it.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "key": r"(?<![\p{L}\p{N}_-])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36}(?![0-9A-Za-z])|sk-(?:proj-)?[A-Za-z0-9_-]{32,})",
    "secret": rf"(?=[0-9a-zA-Z+/_~-]{{16}})(?:{_said})(?:[0-9a-fA-F]{{20,}}(?![\p{{L}}\p{{N}}])|(?=[a-zA-Z+/_~-]*\d)[0-9a-zA-Z+/_~-]{{16,}}={{0,2}})",
    "password": r"(?<=[=\"'])(?<=(?i:password|passwd|pwd)\s{0,1}=\s{0,1}[\"']?)[^\s\"',;&<>=]{6,}",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\p{L}\p{N}:])",
    "ip": rf"(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ -]?\(?\d{1,4}\)?(?:[ -]?\d{2,4}){2,4}(?!\d)|(?<![\p{N}(])(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_titles})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
ANY = "|".join(PATTERNS.values())
#: A text without any of this has no entity.
HINT = rf"[0-9@]|(?i:password|passwd|pwd)|sk-|gh[pousr]_|(?:{_titles})\.? |:[A-Fa-f]"
#: Types whose normal form is their digits.
NUMBERS = ["phone", "ssn", "card"]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return _chars(F.regexp_replace(s, "[^0-9]", ""))


def luhn(s: Column) -> Column:
    """Does the number pass the Luhn test? Every second digit from the right counts double."""
    back = F.reverse(_digits(s))
    parts = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return (F.size(back) >= 13) & (F.size(back) <= 19) & (F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0)


def mod97(s: Column) -> Column:
    """The rest by 97 of an account number, letters counting from 10, its first four characters last."""
    moved = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(moved), F.lit(0), step)


def kind_of(s: Column) -> Column:
    """The type of a match, or null for a number that fails its test."""
    is_ = lambda k: s.rlike(f"^(?:{PATTERNS[k]})$")
    kind = F.when(is_("email"), "email").when(is_("key"), "key").when(is_("ip6"), "ip6").when(is_("ip"), "ip").when(is_("ssn"), "ssn")
    kind = kind.when(is_("phone"), "phone").when(is_("iban"), F.when(mod97(F.regexp_replace(s, " ", "")) == 1, "iban"))
    kind = kind.when(s.rlike(r"^\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}$"), F.when(luhn(s), "card"))
    return kind.when(is_("name") | s.rlike(r"^\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"), "name").otherwise("secret")


def untitled(s: Column) -> Column:
    return F.regexp_replace(s, rf"^(?:{_titles})\.? ", "")


def gender(s: Column) -> Column:
    """Of the title that a name begins with; null without one."""
    out = None
    for g, titles in TITLES.items():
        has = s.rlike(rf"^(?:{'|'.join(titles)})\.? ")
        out = F.when(has, g) if out is None else out.when(has, g)
    return out


def normal(kind: Column, s: Column, g: Column) -> Column:
    """The entities of a mention, by their normal forms: one but for names, which have one a word."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    # +1 and ten digits is the ten digits' own number.
    phone = F.when(s.startswith("+"), F.when(digits.rlike("^1[0-9]{10}$"), F.substr(digits, F.lit(2))).otherwise(F.concat(F.lit("+"), digits))).otherwise(digits)
    one = F.when(kind == "email", F.lower(s)).when(kind == "ip6", F.lower(s)).when(kind == "phone", phone).when(kind.isin(NUMBERS), digits).when(kind == "iban", F.regexp_replace(s, " ", "")).otherwise(s)
    words = F.transform(F.split(untitled(s), " "), lambda w: F.concat(F.coalesce(g, F.lit("n")), F.lit("|"), F.lower(w)))
    return F.when(kind == "name", words).otherwise(F.array(one))


class Draw:
    """Keyed numbers for one value: each place has a hash of its own."""

    def __init__(self, key: str):
        self.seed = F.concat_ws("|", F.lit(key), F.col("kind"), F.col("value"), F.col("tries").cast("string"))

    def __call__(self, place: Column, n) -> Column:
        digest = F.sha2(F.concat_ws("|", self.seed, place.cast("string")).cast("binary"), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))

    def of(self, letters, place: Column) -> Column:
        letters = F.lit(letters) if isinstance(letters, str) else letters
        return F.substr(letters, (self(place, F.length(letters)) + 1).cast("int"), F.lit(1))

    def more(self, letters: str) -> Column:
        """No letter in the first rounds, one more in each that follows."""
        extra = F.greatest(F.lit(0), F.col("tries") - WIDEN + 1)
        return F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), extra), lambda i: self.of(letters, -i)), "")).otherwise("")


def shaped(draw: Draw, s: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """s with every digit and letter drawn anew, of the same case and script; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        low = F.when(c.rlike("[0-9]"), draw.of("0123456789", i)).when(c.rlike("[A-Za-z]"), draw.of(letters, i))
        low = low.when(c.rlike(r"\p{IsCyrillic}"), draw.of(LETTERS["cyrillic"], i)).when(c.rlike(r"\p{IsGreek}"), draw.of(LETTERS["greek"], i)).when(c.rlike(r"\p{L}"), draw.of(LETTERS["other"], i)).otherwise(c)
        return F.when(c.rlike(r"\p{Lu}"), F.upper(low)).otherwise(low)

    return F.array_join(F.transform(_chars(s), one), "")


def _hexadecimal(draw: Draw, s: Column) -> Column:
    any_ = lambda c, i: F.when(c.rlike("[0-9a-f]"), draw.of("0123456789abcdef", i)).when(c.rlike("[A-F]"), draw.of("0123456789ABCDEF", i)).otherwise(c)
    return F.array_join(F.transform(_chars(s), any_), "")


def _digits_for(draw: Draw, s: Column) -> Column:
    return F.array_join(F.transform(_chars(s), lambda c, i: draw.of("0123456789", i)), "")


def _card(draw: Draw, digits: Column) -> Column:
    """As many digits, the first kept, the last such that the Luhn test is passed."""
    n = F.length(digits)
    drawn = F.transform(F.slice(_chars(digits), 1, n - 1), lambda c, i: F.when(i == 0, c.cast("int")).otherwise(draw(i, 10).cast("int")))
    # From the right, without the check digit, the first counts double.
    twice = F.transform(F.reverse(drawn), lambda d, i: F.when(i % 2 == 0, (d * 2) % 10 + F.floor(d / 5).cast("int")).otherwise(d))
    last = F.pmod(-F.aggregate(twice, F.lit(0), lambda a, b: a + b), F.lit(10)).cast("int")
    return F.concat(F.array_join(drawn, ""), last.cast("string"))


def _iban(draw: Draw, s: Column) -> Column:
    """The same country and layout, with check digits."""
    rest = F.array_join(F.transform(_chars(F.substr(s, F.lit(5))), lambda c, i: F.when(c.rlike("[0-9]"), draw.of("0123456789", i)).otherwise(draw.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))), "")
    country = F.substring(s, 1, 2)
    check = F.lit(98) - mod97(F.concat(country, F.lit("00"), rest))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)


def _ip(draw: Draw, s: Column) -> Column:
    """Octets of the same width, and of any once that has too few values."""

    def octet(c: Column, i: Column) -> Column:
        n = F.when(F.col("tries") < WIDEN, F.length(c)).otherwise(0)
        return F.when(n == 0, draw(i, 256)).when(n == 1, draw(i, 10)).when(n == 2, draw(i, 90) + 10).otherwise(draw(i, 156) + 100).cast("string")

    return F.array_join(F.transform(F.split(s, r"\."), octet), ".")


def _stem(draw: Draw, pieces: Column, places: Column) -> Column:
    return F.array_join(F.transform(places, lambda i: F.get(pieces, draw(i, 32).cast("int"))), "")


def _name(draw: Draw, s: Column) -> Column:
    """A word of the script and gender, in lower case; a syllable more in each round from WIDEN on."""
    g, word = F.substring(s, 1, 1), F.substr(s, F.lit(3))
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    syllables = F.sequence(F.lit(1), F.lit(3) + F.greatest(F.lit(0), F.col("tries") - WIDEN + 1))
    out = None
    for name, all_ in SYLLABLES.items():
        stem = _stem(draw, F.array(*map(F.lit, all_.split())), syllables)
        end = None
        for which, ends in ENDINGS[name].items():
            drawn = F.get(F.array(*map(F.lit, ends.split())), draw(F.lit(0), 3).cast("int"))
            end = F.when(g == which, drawn) if end is None else end.when(g == which, drawn)
        made = F.concat(stem, end)
        out = F.when(script == name, made) if out is None else out.when(script == name, made)
    return out


def surrogate(key: str) -> Column:
    """The surrogate of the normal form (kind, value) at its number of tries, in normal form."""
    draw, v = Draw(key), F.col("value")
    local, rest, top = (F.regexp_extract(v, r"^([^@]*)(@.*)(\.[^.]*)$", k) for k in (1, 2, 3))
    out = F.when(F.col("kind") == "email", F.concat(shaped(draw, F.concat(local, rest)), draw.more("abcdefghijklmnopqrstuvwxyz"), top))
    out = out.when(F.col("kind") == "ip", _ip(draw, v)).when(F.col("kind") == "ip6", _hexadecimal(draw, v))
    # The first digit of an international number stays: it tells the part of the world.
    start = F.regexp_extract(v, r"^(\+\d|)", 1)
    out = out.when(F.col("kind") == "phone", F.concat(start, _digits_for(draw, F.regexp_replace(v, r"^\+\d", "")), draw.more("0123456789")))
    out = out.when(F.col("kind") == "ssn", F.concat(_digits_for(draw, v), draw.more("0123456789")))
    out = out.when(F.col("kind") == "card", _card(draw, v)).when(F.col("kind") == "iban", _iban(draw, v)).when(F.col("kind") == "name", _name(draw, v))
    form = r"^(AKIA|gh[pousr]_|sk-proj-|sk-|)"
    out = out.when(F.col("kind") == "key", F.concat(F.regexp_extract(v, form, 1), shaped(draw, F.regexp_replace(v, form, ""))))
    return out.when(v.rlike("^(?:[0-9a-f]*|[0-9A-F]*)$"), _hexadecimal(draw, v)).otherwise(F.concat(shaped(draw, v), draw.more("abcdefghijklmnopqrstuvwxyz")))


def plain(kind: Column, value: Column) -> Column:
    """What a normal form and a surrogate have in common to be told apart by: a name has no gender in a text."""
    return F.when(kind == "name", F.regexp_replace(value, r"^[fmn]\|", "")).otherwise(value)


def assign(values: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, value, surrogate), the surrogates of a kind distinct and none a value of that kind.

    values are distinct normal forms. Each round draws for those still open, so rounds soon are small.
    """
    n = width(values.sparkSession)
    # Dealt by count: few bytes, but each costs a hundred hashes.
    pending = values.withColumn("tries", F.lit(0))
    known = values.select("kind", plain(F.col("kind"), F.col("value")).alias("made")).distinct()
    done = None
    for k in range(ROUNDS):
        drawn = pending.repartition(n, "kind", "value").withColumn("made", surrogate(key))
        drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "made").orderBy("value")))
        taken = known if done is None else known.unionByName(done.select("kind", F.col("surrogate").alias("made"))).distinct()
        drawn = drawn.join(taken.withColumn("taken", F.lit(True)), ["kind", "made"], "left")
        drawn = scratch.table(f"drawn{k}", drawn.select("kind", "value", "tries", "made", ((F.col("rank") == 1) & F.col("taken").isNull()).alias("good")))
        good = drawn.filter("good").select("kind", "value", F.col("made").alias("surrogate"))
        done = good if done is None else done.unionByName(good)
        pending = drawn.filter("NOT good").select("kind", "value", (F.col("tries") + 1).alias("tries"))
        if pending.isEmpty():
            return done
    raise RuntimeError("surrogates could not be drawn apart")


def laid(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogates of a mention's entities in its own case and separators."""
    one = F.get(made, 0)
    upper = F.array_join(F.transform(_chars(one), lambda c, i: F.when(F.substr(mention, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    # +1 stays where the entity is the ten digits after it.
    digits = F.regexp_replace(one, r"^\+", "")
    skip = F.length(F.regexp_replace(mention, "[^0-9]", "")) - F.length(digits)
    digits = F.concat(F.when((kind == "phone") & mention.startswith("+1") & ~one.startswith("+") & (skip == 1), "1").otherwise(""), digits)

    def filled(is_place: str, content: Column) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), f"[^{is_place}]", ""))
        inside = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.rlike(f"[{is_place}]"), F.substr(content, place(i), F.lit(1))).otherwise(c)), "")
        return F.concat(inside, F.substr(content, F.length(F.regexp_replace(mention, f"[^{is_place}]", "")) + 1))

    title = F.regexp_extract(mention, rf"^((?:{_titles})\.? |)", 1)
    name = F.concat(title, F.array_join(F.transform(made, lambda w: F.initcap(w)), " "))
    out = F.when(kind.isin("email", "ip6"), upper).when(kind.isin(NUMBERS), filled("0-9", digits))
    return out.when(kind == "iban", filled("A-Z0-9", one)).when(kind == "name", name).otherwise(one)


def pseudonymize(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """docs with the entities in text replaced, and n_entities, the number of mentions replaced.

    A column n_entities in docs is replaced, names that begin with pi_ are used inside; all other columns and
    every row stay. Null text stays null and has 0 entities, as has empty text. Texts of any length are read
    whole; where entities overlap, the one that begins first counts, and of two that begin together the first
    in PATTERNS. Texts without entities are not shuffled or changed by a byte. Equal texts get equal results,
    also in repeated rows. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    base = docs.drop("n_entities")
    columns, body = base.columns, F.col(text).cast("string")
    hint = F.coalesce(body.rlike(HINT), F.lit(False))
    titled = F.filter(F.when(hint, F.regexp_extract_all(body, F.lit(PATTERNS["name"]), 0)), lambda v: untitled(v).contains(" "))
    # Full names that a title goes before are looked for without one, too: letters and a space only.
    full = F.array_join(F.array_distinct(F.transform(titled, untitled)), "|")
    tagged = base.withColumn("pi_any", F.when(F.size(titled) > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), full, F.lit(r")(?!\p{L})"))).otherwise(F.lit(ANY)))
    tagged = tagged.withColumn("pi_found", F.when(hint, F.regexp_extract_all(body, F.col("pi_any"), 0)).otherwise(F.array().cast("array<string>")))
    tagged = tagged.withColumn("pi_found", F.transform("pi_found", lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value"))))
    # Written, since what it costs to find entities in all texts would be paid again for those without.
    tagged = scratch.table("tagged", tagged.withColumn("pi_some", F.exists("pi_found", lambda x: x["kind"].isNotNull())))
    clean = tagged.filter("NOT pi_some").select(*columns, F.lit(0).alias("n_entities"))
    found = tagged.filter("pi_some").withColumn("pi_text", F.sha2(body.cast("binary"), 256))
    mentions = found.groupBy("pi_text").agg(F.first("pi_found").alias("pi_found"))
    same = lambda x, y: (x["kind"] == "name") & (untitled(x["value"]) == untitled(y)) & gender(x["value"]).isNotNull()
    of = lambda x: F.coalesce(gender(x["value"]), gender(F.get(F.filter("pi_found", lambda y: same(y, x["value"])), 0)["value"]))
    mentions = mentions.select("pi_text", F.posexplode(F.transform("pi_found", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), normal(x["kind"], x["value"], of(x)).alias("normal")))).alias("pi_at", "m"))
    mentions = scratch.table("mentions", mentions.select("pi_text", "pi_at", F.col("m.kind").alias("kind"), F.col("m.value").alias("mention"), F.col("m.normal").alias("normal")))
    entities = mentions.filter("kind IS NOT NULL").select("pi_text", "pi_at", "kind", "mention", F.posexplode("normal").alias("word", "value"))
    known = assign(entities.select("kind", "value").distinct(), key, scratch)
    made = entities.join(known, ["kind", "value"]).groupBy("pi_text", "pi_at", "kind", "mention").agg(F.sort_array(F.collect_list(F.struct("word", "surrogate"))).alias("made"))
    made = made.select("pi_text", "pi_at", laid(F.col("kind"), F.col("mention"), F.col("made")["surrogate"]).alias("to"))
    made = made.unionByName(mentions.filter("kind IS NULL").select("pi_text", "pi_at", F.col("mention").alias("to")))
    parts = made.groupBy("pi_text").agg(F.sort_array(F.collect_list(F.struct("pi_at", "to"))).alias("pi_parts"))
    gaps = F.split(body, F.col("pi_any"), -1)
    joined = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(F.col("pi_parts")["to"], i), F.lit(""))))), "")
    count = F.size(F.filter("pi_found", lambda x: x["kind"].isNotNull()))
    changed = found.join(parts, "pi_text").select(*(joined.alias(c) if c == text else F.col(c) for c in columns), count.alias("n_entities"))
    return clean.unionByName(changed)


def op9_pii(spark, sf_dir):
    """documents with surrogates for their entities."""
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), "tidemark")
