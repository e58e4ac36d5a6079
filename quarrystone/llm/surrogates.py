"""PII surrogates: keyed, type-consistent replacements for detected entities, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, without

KEY = "surrogates-1"
ROUNDS = 60
#: Attempts after which a format of fixed length gives way: a sign more for every so many.
GIVE = 8

#: Titles that open a name, by gender (fixed values).
MALE = ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος", "السيد", "श्री", "מר")
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Madame", "Señora", "Госпожа", "Κυρία", "السيدة", "श्रीमती", "גברת")
EITHER = ("Dr.", "Dr", "Prof.", "Prof")
#: Calling codes of two digits; 1 and 7 are of one, all others of three (fixed values).
TWO_DIGIT_CODES = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
LABELS = ("token", "secret", "password", "api_key")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(sorted((t.replace(".", r"\.") for t in MALE + FEMALE + EITHER), key=len, reverse=True))
_NAME = r"(?:\p{Lu}\p{L}*+|\p{Lo}[\p{L}\p{M}]++)(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
#: What each type looks like from a place on that no letter or digit precedes; the first that fits counts. Words are taken
#: possessively and repeated groups are bounded or possessive, so that a text is searched in time that grows with its length, on a small stack.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,255}+@[\p{L}\p{N}][\p{L}\p{N}-]{0,62}+(?:\.[\p{L}\p{N}][\p{L}\p{N}-]{0,62}+){1,126}+",
    "phone": r"\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{2,4})){2,5}(?!\d)",
    "secret": r"(?i:(?<=(?:token|secret|password|api_key) {0,2}[=:] {0,2}[\"']?)[0-9a-f]{32,64}(?![0-9a-z]))",
    "card": r"(?<!\.)(?:[2-6]\d{3}(?:\d{12}| \d{4} \d{4} \d{4}|-\d{4}-\d{4}-\d{4})|3[47]\d{2}(?:\d{11}| \d{6} \d{5}|-\d{6}-\d{5}))(?!\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "line": r"(?<![-./+])(?:\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}|0\d{1,4}[ /]\d{3,4}[ -]?\d{3,4})(?![\d/-]|\.\d)",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "name": rf"(?:{_TITLE}) {_NAME}(?: {_NAME})?",
}
#: The same types by the found text alone, where a pattern looks at what stands before.
ALONE = PATTERNS | {"secret": r"[0-9A-Fa-f]{32,64}"}
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(PATTERNS.values()) + ")"

#: Letters that stand for a script's letters in addresses, and parts of made-up names by script: what syllables begin with, what they end in, and the ends of male and female names (fixed values).
LETTERS = {
    "Cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "Han": "安白常成春方高光国海红华建江金静军兰丽林明宁平青山书水天文雪阳玉元云志中",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモ",
    "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호기니디리미비시이지",
    "Latin": "abcdefghijklmnopqrstuvwxyz",
}
SYLLABLES = {
    "Latin": ("b d f g h k l m n p r s t v w z", "a e i o u", "n r s l", "a ia ina"),
    "Cyrillic": ("б в г д з к л м н п р с т ф х ч", "а е и о у", "н р в л", "а ия ина"),
    "Greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ", "α ε ι ο ω", "ης ος ας", "α η ια"),
    "Arabic": ("ب ت ج د ر ز س ش ع ف ق ك ل م ن ه", "ا و ي", "ر ن د م", "ة اء ى"),
    "Hebrew": ("ב ג ד ה ז ח ט כ ל מ נ ס פ ק ר ש ת", "א ו י", "ל ר ד", "ה ית"),
    "Devanagari": ("क ख ग च ज ट ड त द न प ब म य र ल व श स ह", "ा ि ी ु े ो", "न श र", "ा ी िका"),
}
SYLLABLES |= {s: (" ".join(LETTERS[s]), "", "", "") for s in ("Han", "Hiragana", "Katakana", "Hangul")}


def hint(text: Column) -> Column:
    """Whether a text may hold any of them, told at little cost: an at sign, two digits side by side or around a sign, a label, a title."""
    low = F.lower(text)
    signs = [F.contains(text, F.lit("@")), text.rlike("[0-9].?[0-9]"), *[F.contains(low, F.lit(x)) for x in LABELS]]
    stems = [t for t in MALE + FEMALE + EITHER if not any(o != t and t.startswith(o) for o in MALE + FEMALE + EITHER)]
    return F.coalesce(reduce(lambda a, b: a | b, signs + [F.contains(text, F.lit(t)) for t in stems]), F.lit(False))


def _hash(key: str, *parts: Column) -> Column:
    """128 hex digits fixed by the key and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _byte(h: Column, i: Column) -> Column:
    """The i-th of the 64 numbers below 256 in a hash, i counted from 0; beyond 64 they are taken anew from the hash and the turn."""
    turned = F.when(i < 64, h).otherwise(F.sha2(F.concat(h, F.floor(i / 64).cast("string")), 512))
    return F.conv(F.substring(turned, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(h: Column, i: Column, row: str | list[str]) -> Column:
    """One of a row's signs by the i-th number of a hash."""
    return F.element_at(F.array(*[F.lit(x) for x in row]), (_byte(h, i) % len(row) + 1).cast("int"))


def _run(n: Column) -> Column:
    """0 .. n - 1; empty for none."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _digits(h: Column, n: Column) -> Column:
    return F.array_join(F.transform(_run(n), lambda i: (_byte(h, i) % 10).cast("string")), "")


def _spelled(word: Column, h: Column, more: Column) -> Column:
    """A word of the same form and `more` letters: digits for digits, letters of its script for letters, signs as they are."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"^[0-9]$"), (_byte(h, i) % 10).cast("string"))
        for script, row in LETTERS.items():
            if script != "Latin":
                out = out.when(c.rlike(rf"^[\p{{Is{script}}}&&\p{{L}}]$"), _pick(h, i, row))
        return out.when(c.rlike(r"^\p{L}$"), _pick(h, i, LETTERS["Latin"])).otherwise(c)

    extra = F.transform(_run(more), lambda i: _pick(h, 63 - i, LETTERS["Latin"]))
    return F.concat(F.array_join(F.transform(F.split(word, ""), one), ""), F.array_join(extra, ""))


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _checked(digits: Column) -> Column:
    """digits with the last replaced by the check digit of the others."""
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), luhn)
    return fits[0]


def _kind(surface: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ALONE.items()):
        out = F.when(surface.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _plain_digits(surface: Column) -> Column:
    return F.regexp_replace(surface, "[^0-9]", "")


def _valid(kind: Column, surface: Column) -> Column:
    """Whether a surface is one of its kind: a card's check digit, the number of a phone's digits."""
    digits = _plain_digits(surface)
    return kind.isNotNull() & ((kind != "card") | luhn(digits)) & ((kind != "phone") | F.length(digits).between(8, 15))


def _script(word: Column) -> Column:
    out = F.lit("Latin")
    for script in SYLLABLES:
        if script != "Latin":
            out = F.when(word.rlike(rf"[\p{{Is{script}}}&&\p{{L}}]"), script).otherwise(out)
    return out


def _parts(kind: Column, surface: Column) -> Column:
    """What a surface refers to: (type, canon, and what a name's title says of the gender), one for most types, two for an address (its name within its domain, and the domain) and for a full name."""
    words = F.split(surface, " ")
    word = lambda k: F.lower(F.get(words, F.lit(k)))
    title = F.get(words, F.lit(0))
    gender = F.when(title.isin(*MALE), "male").when(title.isin(*FEMALE), "female").otherwise("any")
    part = lambda t, c, g=None: F.struct(t.alias("type"), c.alias("canon"), (F.lit("any") if g is None else g).alias("gender"))
    given = part(F.concat(F.lit("name given "), _script(word(1))), word(1), gender)
    family = lambda k: part(F.concat(F.lit("name  "), _script(word(k))), word(k))
    address = F.split(F.lower(surface), "@")
    email = F.array(part(F.concat(F.lit("local "), F.get(address, F.lit(1))), F.get(address, F.lit(0))), part(F.lit("domain"), F.get(address, F.lit(1))))
    canon = F.when(kind == "secret", F.lower(surface)).when(kind.isin("phone", "card", "ssn", "line"), _plain_digits(surface)).otherwise(surface)
    named = F.when(F.size(words) > 2, F.array(given, family(2))).otherwise(F.array(family(1)))
    return F.when(kind == "email", email).when(kind == "name", named).otherwise(F.array(part(kind, canon)))


def _gendered(parts: DataFrame) -> DataFrame:
    """(type, canon, form): entities of parts, a given name's form by the gender that its titles agree on; the entity is the same under any of them."""
    of = parts.groupBy("type", "canon").agg(F.bool_or(F.col("gender") == "male").alias("m"), F.bool_or(F.col("gender") == "female").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "male").when(F.col("f") & ~F.col("m"), "female").otherwise("any")
    form = F.when(F.col("type").startswith("name given "), F.concat(F.lit("name "), gender, F.substring("type", 11, 1 << 20))).otherwise(F.col("type"))
    return of.select("type", "canon", form.alias("form"))


def _of(table: dict[str, list[str]], key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, row in table.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in row]))]), key)


def _name(type_: Column, canon: Column, h: Column, attempt: Column) -> Column:
    """A made-up name: syllables of the script, one more for each attempt, and an end of the gender; hyphened like the real one. The type holds both."""
    words = F.split(type_, " ")
    gender, script = F.get(words, F.lit(1)), F.get(words, F.lit(2))
    rows = {s: [row.split() or [""] for row in parts] for s, parts in SYLLABLES.items()}
    onset, vowel = (_of({s: r[k] for s, r in rows.items()}, script) for k in (0, 1))
    ends = _of({f"{g} {s}": {"male": r[2], "female": r[3], "any": r[2] + r[3], "": [""]}[g] for s, r in rows.items() for g in ("male", "female", "any", "")}, F.concat(gender, F.lit(" "), script))
    pick = lambda i, row: F.element_at(row, (_byte(h, i) % F.size(row) + 1).cast("int"))
    closed = gender.isin("", "female") & (F.size(vowel) > 1)

    def made(shift: int) -> Column:
        syllables = F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: F.concat(pick(shift + i * 2, onset), pick(shift + i * 2 + 1, vowel)))
        return F.concat(F.array_join(syllables, ""), F.when(closed, pick(F.lit(shift + 30), onset)).otherwise(""), pick(F.lit(shift + 31), ends))

    sign = F.regexp_extract(canon, "['’-]", 0)
    return F.when(sign == "", made(0)).otherwise(F.concat(made(0), sign, made(32)))


def _make(key: str, type_: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an entity in canonical form, at an attempt. Forms grow with attempts, so that there is room for any number of entities."""
    h = _hash(key, type_, canon, attempt.cast("string"))
    n, more = F.length(canon), F.floor(attempt / GIVE).cast("int")
    local = _spelled(canon, h, F.floor(attempt / 3).cast("int"))
    domain = F.concat(_spelled(F.regexp_replace(canon, r"\.[^.]*$", ""), h, F.floor(attempt / 3).cast("int")), F.lit(".example"))
    code = F.when(F.substring(canon, 1, 1).isin("1", "7"), 1).when(F.substring(canon, 1, 2).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
    phone = F.concat(F.substring(canon, F.lit(1), code), _digits(h, n - code + more))  # the country's digits stay
    trunk = F.when(F.substring(canon, 1, 1) == "0", "0").otherwise((_byte(h, F.lit(63)) % 8 + 2).cast("string"))
    line = F.concat(trunk, _digits(h, n - 1 + more))
    kept = F.when(F.substring(canon, 1, 1) == "3", 2).otherwise(1)  # the network's digits stay
    card = _checked(F.concat(F.substring(canon, F.lit(1), kept), _digits(h, n - kept)))
    ssn = F.when(attempt < GIVE, F.concat(F.lit("9"), _digits(h, n - 1))).otherwise(_digits(h, n + more - 1))
    octet = lambda k: _byte(h, F.lit(k)).cast("string")
    first = F.when(attempt < 3, "10").when(attempt < 10, (_byte(h, F.lit(9)) % 16 + 240).cast("string")).otherwise((_byte(h, F.lit(9)) % 223 + 1).cast("string"))
    ip = F.concat_ws(".", first, octet(0), octet(1), octet(2))
    out = F.when(type_.startswith("local "), local).when(type_ == "domain", domain).when(type_ == "phone", phone).when(type_ == "line", line)
    out = out.when(type_ == "card", card).when(type_ == "ssn", ssn).when(type_ == "secret", F.substring(h, F.lit(1), n)).when(type_ == "ip", ip)
    return out.when(type_.startswith("name "), _name(type_, canon, h, attempt))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, canon, surrogate) for distinct entities, no two of a type alike and none equal to a real entity of its type. form, if there is such a column, tells how one is made where types don't.

    Surrogates are keyed hashes, so equal entities always get equal ones. In each round those that clash with a real
    entity, with one settled before or, all but the first, with each other are made anew at the next attempt; the others are settled.
    Forms have more room at each attempt, so a few rounds do for any number of entities.
    """
    form = F.col("form" if "form" in entities.columns else "type")
    now = hold(entities.select("type", "canon", form.alias("form"), F.lit(0).alias("attempt")), "entities")
    taken = now.select("type", F.col("canon").alias("surrogate"))
    settled = []
    for _ in range(ROUNDS):
        made = hold(now.withColumn("surrogate", _make(key, F.col("form"), F.col("canon"), F.col("attempt"))), "made")
        firsts = made.groupBy("type", "surrogate").agg(F.min("canon").alias("canon"))
        settled.append(hold(firsts.join(taken, ["type", "surrogate"], "left_anti"), "settled").select("type", "canon", "surrogate"))
        taken = taken.unionByName(settled[-1].select("type", "surrogate"))
        now = hold(made.join(settled[-1], ["type", "canon"], "left_anti").select("type", "canon", "form", (F.col("attempt") + 1).alias("attempt")), "unsettled")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, settled)
    raise RuntimeError("surrogates still clash: a type's entities fill its format")


def _recased(surface: Column, made: Column) -> Column:
    """made with a capital wherever the surface has one."""
    one = lambda c, i: F.when(F.substring(surface, i + 1, F.lit(1)) != F.lower(F.substring(surface, i + 1, F.lit(1))), F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(made, ""), one), "")


def _dressed(kind: Column, surface: Column, made: Column) -> Column:
    """Surrogates (an array, in the order of the parts) in the form of the surface: its case, its signs between digits, its title."""
    one, two = F.get(made, F.lit(0)), F.get(made, F.lit(1))
    digit = lambda c, i: F.when(
        c.rlike("^[0-9]$"), F.substring(one, F.length(_plain_digits(F.substring(surface, F.lit(1), i))) + 1, F.lit(1))
    ).otherwise(c)
    filled = F.concat(F.array_join(F.transform(F.split(surface, ""), digit), ""), F.substring(one, F.length(_plain_digits(surface)) + 1, F.lit(99)))
    capital = (surface == F.upper(surface)) & (surface != F.lower(surface))
    at = F.split(surface, "@")
    site = F.regexp_replace(F.get(at, F.lit(1)), r"\.[^.]*$", "")
    email = F.concat(_recased(F.get(at, F.lit(0)), one), F.lit("@"), _recased(site, F.regexp_replace(two, r"\.[^.]*$", "")), F.when(capital, ".EXAMPLE").otherwise(".example"))
    pieces = lambda m: F.array_join(F.transform(F.split(m, "(?<=['’-])"), F.initcap), "")
    words = F.slice(F.split(surface, " "), 2, 2)
    cased = F.zip_with(words, made, lambda w, m: F.when((w == F.upper(w)) & (w != F.lower(w)), F.upper(m)).otherwise(pieces(m)))
    name = F.concat(F.get(F.split(surface, " "), F.lit(0)), F.lit(" "), F.array_join(cased, " "))
    dressed = F.when(kind.isin("phone", "card", "ssn", "line"), filled).when(kind == "name", name).when(kind == "email", email)
    return dressed.when(capital, F.upper(one)).otherwise(one)


def replace(docs: DataFrame, key: str = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with entities in text replaced, and n_replaced (how many).

    Emails, phones with their country's code, national lines, cards (with a valid check digit), social security numbers, secrets after their label, addresses and titled names are found by pattern.
    An entity has one surrogate wherever and however it is written, so mentions stay together, and different
    entities, and different domains of addresses, stay different. A surrogate keeps the type and format: case, script, signs, lengths, a card's network and check digit, a phone's country,
    a name's hyphens and apostrophes, and its gender where its titles agree on one. An address has up to 256 signs before the @ and 127 parts of 63 behind it; what goes on beyond stays as text. Texts without entities pass by unshuffled; of the others, distinct mentions are
    joined with their surrogates and gathered by document. Null texts stay null; repeated rows stay; an empty table gives no rows.
    """
    named = [c for c in docs.columns if c.lower() != "n_replaced"]
    rows = without(docs, "n_replaced")
    some = hint(F.col(text))
    having = rows.where(some).withColumn("__pii_key", F.xxhash64(F.col(doc_id), F.col(text)))
    hits = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    mentions = having.select(F.col(doc_id).alias("__pii_of"), "__pii_key", F.explode_outer(F.array_distinct(hits)).alias("surface"))  # outer: searched once, not again by a filter
    mentions = hold(mentions.where("surface is not null"), "mentions")
    surfaces = mentions.select("surface").distinct().withColumn("kind", _kind(F.col("surface")))
    surfaces = hold(surfaces.where(_valid(F.col("kind"), F.col("surface"))).withColumn("parts", _parts(F.col("kind"), F.col("surface"))), "surfaces")
    entities = hold(_gendered(surfaces.select(F.inline("parts"))), "gendered")
    made = assign(entities, key)
    parts = surfaces.select("surface", "kind", F.posexplode("parts").alias("nth", "part")).select("surface", "kind", "nth", F.col("part.type").alias("type"), F.col("part.canon").alias("canon"))
    dressed = parts.join(made, ["type", "canon"]).groupBy("surface", "kind").agg(F.array_sort(F.collect_list(F.struct("nth", "surrogate"))).alias("made"))
    dressed = hold(dressed.select("surface", _dressed(F.col("kind"), F.col("surface"), F.col("made.surrogate")).alias("replacement")), "dressed")
    maps = mentions.join(dressed, "surface").groupBy("__pii_of", "__pii_key").agg(F.map_from_entries(F.collect_set(F.struct("surface", "replacement"))).alias("__pii_map"))
    joined = having.join(maps, having[doc_id].eqNullSafe(maps["__pii_of"]) & (having["__pii_key"] == maps["__pii_key"]), "left").drop(maps["__pii_key"])
    value = lambda h: F.coalesce(F.element_at("__pii_map", h), h)
    whole = F.array_join(F.zip_with(F.split(F.col(text), ANY, -1), hits, lambda p, h: F.concat(p, F.coalesce(value(h), F.lit("")))), "")
    n = F.size(F.filter(hits, lambda h: F.map_contains_key("__pii_map", h))).cast("long")
    found = F.col("__pii_map").isNotNull()
    changed = joined.withColumn("n_replaced", F.when(found, n).otherwise(F.lit(0).cast("long"))).withColumn(text, F.when(found, whole).otherwise(F.col(text)))
    same = rows.where(~some).withColumn("n_replaced", F.lit(0).cast("long"))
    return changed.select(*named, "n_replaced").unionByName(same.select(*named, "n_replaced"))
