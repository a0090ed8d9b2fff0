"""Surrogates for personal data (DataFrame functions only).

Detected entities are brought to a key form, so that mentions of one entity in several spellings are one entity; a keyed hash
makes each distinct entity a replacement of its own type, format, script and, for names, gender; entities whose
replacements meet, or are themselves real entities, are hashed again until all differ. The mapping is a
table that is joined to the mentions, so an entity has one replacement in all documents.

Names are runs of capitalised words with a known given name before another word, or after a title or a cue such as "name
is". Given and family names are replaced word by word, so that a name's parts, alone or in another order, follow
the whole wherever a document has both.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpanel.llm.common import cut, forget

#: Given names by script and gender; a known name's replacement is another one of its list.
GIVEN = {
    "latin_f": "Anna Maria Emma Julia Laura Sarah Elena Sofia Clara Alice Emily Hannah Carmen Lucia Marie Claire Ingrid Helga Teresa Paula Olivia Nora Greta Camille Nancy Mary Linda Susan Karen Lisa Ruth Jane Margaret Barbara".split(),
    "latin_m": "John James Robert Michael David Thomas Peter Paul Daniel Martin Carlos Pedro Miguel Pablo Jean Pierre Louis Hans Klaus Stefan Lukas Marco Antonio William Joseph George Henry Charles Edward Richard Andrew Stephen Jack Samuel".split(),
    "cyrillic_f": "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия".split(),
    "cyrillic_m": "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел Виктор".split(),
    "greek_f": "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Βασιλική Δήμητρα".split(),
    "greek_m": "Γιώργος Γιάννης Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης Χρήστος".split(),
}
_NAMES = sorted({n for x in GIVEN.values() for n in x})
#: A capitalised word; a title, after which a single word is a family name; a cue, after which it is a given name.
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:-?\p{Lu}\p{Ll}++)*+"
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame|Mme)\.? "
CUE = r"(?:[Nn]ame(?: is|:)|[Dd]ear|[Ss]igned(?: by|,)) "
RUN = rf"{WORD}(?: {WORD})*+"
#: Types in the order in which they are tried at one place, with their patterns. None begins inside a word or number.
PATTERNS = {
    "email": r"[\w.+%-]++@[\w-]++(?:\.[\w-]++)+",
    "secret": r"(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])|(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\.)\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)",
    "phone": r"(?<!\+)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}(?!\d)|(?<!\()\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "name": rf"(?:{TITLE}|{CUE}){RUN}|{WORD}(?: {WORD})++",
}
_START = r"(?<![\p{L}\p{N}])"


def _everything(name: str) -> str:
    """One pattern for all types: inside a word it costs one look at the character before."""
    parts, shift = [], 0
    for k, p in PATTERNS.items():
        p = name if k == "name" else p
        parts.append(f"(?:{p})" if r"\1" not in p else f"(?:{p})".replace(r"\1", rf"\{shift + 1}"))
        shift += r"\1" in p
    return f"{_START}(?:{'|'.join(parts)})"


#: What is looked for in all texts; and what is looked at again in the texts that have some of it: single words too.
FIND, WEAVE = _everything(PATTERNS["name"]), _everything(RUN)
_ALPHABETS = (
    ("aeiou", "bcdfghjklmnpqrstvwxz"), ("AEIOU", "BCDFGHJKLMNPQRSTVWXZ"), ("аеиоуюя", "бвгдзклмнпрстфх"), ("АЕИОУЮЯ", "БВГДЗКЛМНПРСТФХ"),
    ("αεηιου", "βγδζκλμνπρστφχ"), ("ΑΕΗΙΟΥ", "ΒΓΔΖΚΛΜΝΠΡΣΤΦΧ"),
)


def _name_words(mention: Column) -> Column:
    """(given, family words) of a run of words: what follows a title or cue, or begins with a known given name; else null."""
    bare = F.split(F.regexp_replace(mention, rf"\A(?:{TITLE}|{CUE})", ""), " ")
    known = F.array(*[F.lit(n) for n in _NAMES])
    # The first known given name that another word follows.
    at = F.array_min(F.filter(F.transform(bare, lambda w, i: F.when(F.array_contains(known, w) & (i < F.size(bare) - 1), i + 1)), lambda i: i.isNotNull()))
    part = F.when(mention.rlike(rf"\A(?:{TITLE}|{CUE})"), F.lit(1)).otherwise(at)
    given = F.when(mention.rlike(rf"\A{TITLE}") & (F.size(bare) == 1), F.lit(None).cast("string")).otherwise(F.get(bare, part - 1))
    family = F.when(given.isNull(), bare).otherwise(F.slice(bare, part + 1, F.size(bare)))
    return F.when(part.isNotNull(), F.struct(given.alias("given"), family.alias("family")))


def _kind(mention: Column) -> Column:
    """The type of a mention; a number is a card by its Luhn sum, a run of words a name by ``_name_words``."""
    out = None
    for k, p in PATTERNS.items():
        test = mention.rlike(rf"\A(?:{p})\z")
        if k == "card":
            test = test & (_luhn_sum(F.regexp_replace(mention, r"\D", "")) % 10 == 0)
        if k == "name":
            test = test & _name_words(mention).isNotNull()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out


def _norm(mention: Column, kind: Column) -> Column:
    """The form in which spellings of one entity are equal."""
    packed = F.regexp_replace(mention, r"[ ().\-]", "")
    lower = (kind == "email") | ((kind == "secret") & mention.rlike(r"\A[0-9A-Fa-f]+\z"))
    return F.when(lower, F.lower(mention)).when(kind.isin("ip", "secret", "given", "family"), mention).otherwise(packed)


def _nibbles(seed: Column, n: int = 3) -> Column:
    """Pseudo-random hex digits from a keyed hash."""
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}|"), seed), 256) for i in range(n)])


def _like(text: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit replaced by one of its class (script, case, vowel or not); all else stays."""
    stream = _nibbles(seed)

    def one(c: Column, i: Column) -> Column:
        at = F.conv(F.substr(stream, (i * 2) % 180 + 1, F.lit(3)), 16, 10).cast("int") + i
        pick = lambda s: F.substr(F.lit(s), at % len(s) + 1, F.lit(1))
        out = F.when(c.rlike(r"[0-9]"), pick("0123456789"))
        if hexadecimal:
            out = out.when(c.rlike("[a-f]"), pick("abcdef"))
        for vowels, others in _ALPHABETS:
            out = out.when(F.instr(F.lit(vowels), c) > 0, pick(vowels)).when(F.instr(F.lit(others), c) > 0, pick(others))
        out = out.when(c.rlike(r"\p{IsCyrillic}"), pick(_ALPHABETS[2][1])).when(c.rlike(r"\p{IsGreek}"), pick(_ALPHABETS[4][1]))
        return out.when(c.rlike(r"\p{Lu}"), pick(_ALPHABETS[1][1])).when(c.rlike(r"\p{L}"), pick(_ALPHABETS[0][1])).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(seed: Column) -> Column:
    return F.translate(_nibbles(seed, 1), "abcdef", "135790")


def _luhn_sum(number: Column) -> Column:
    """Luhn sum of a string of digits whose last digit is the check digit."""
    def add(total: Column, x: Column) -> Column:
        return total + x

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), add)


def given_names(key: str) -> dict[str, str]:
    """A keyed permutation of each list of given names, in which no name stays."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        out |= dict(zip(order, [*order[1:], order[0]]))
    return out


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """Replacement, in key form, of an entity in key form."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    digits, n = _digits(seed), F.length(norm)
    card = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(digits, F.lit(1), n - 2))
    check = F.concat(card, F.lit("0"))
    card = F.concat(card, F.when(_luhn_sum(norm) % 10 == 0, ((10 - _luhn_sum(check) % 10) % 10).cast("string")).otherwise(F.substr(digits, n, F.lit(1))))
    country = F.when(norm.startswith("+1"), 2).when(norm.startswith("+7"), 2).when(norm.startswith("+"), 3).otherwise(0)
    phone = F.concat(F.substr(norm, F.lit(1), country), F.substr(digits, F.lit(1), n - country))
    octets = [(F.conv(F.substr(F.sha2(seed, 256), F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int") % 223 + 1).cast("string") for i in range(4)]
    ip = F.concat_ws(".", *octets)
    local, host = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    labels = F.split(host, r"\.")
    tail = F.element_at(labels, -1)
    body = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1))), ".")
    email = F.concat(_like(local, seed), F.lit("@"), _like(body, F.concat(F.lit("d|"), seed)), F.lit("."), tail)
    # Where the words of a length are nearly used up, longer ones follow.
    more = F.repeat(F.lower(F.substring(norm, -2, 2)), F.least(F.floor(attempt / 8), F.lit(4)).cast("int"))
    word = _like(F.concat(norm, more), seed)
    prefix = F.regexp_extract(norm, r"\A(AKIA|gh[pousr]_|sk-|)", 1)
    secret = F.concat(prefix, F.when(prefix == "", _like(norm, seed, True)).otherwise(_like(F.substr(norm, F.length(prefix) + 1), seed)))
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), _like(F.substr(norm, F.lit(3)), seed))
    ssn = F.substr(digits, F.lit(1), n)
    cases = {"email": email, "ip": ip, "given": word, "family": word, "secret": secret, "iban": iban, "ssn": ssn, "phone": phone, "card": card}
    out = None
    for k, v in cases.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def distinct_surrogates(entities: DataFrame, key: str, attempts: int = 40) -> DataFrame:
    """(kind, norm), distinct -> with surrogate: no two alike within a kind, and none a real entity."""
    settled, open_ = None, cut(entities.select("kind", "norm", F.lit(0).alias("attempt")))
    for k in range(attempts):
        tried = cut(open_.select("kind", "norm", surrogate(F.col("kind"), F.col("norm"), F.lit(k), key).alias("surrogate")))
        # The least entity keeps a shared replacement; partial minima, so the count of rivals does not matter.
        first = tried.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        first = first.join(entities.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if settled is not None:
            first = first.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = cut(first.select("kind", "norm", "surrogate"))
        settled = first if settled is None else settled.union(first)
        open_ = cut(open_.join(first.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if open_.isEmpty():
            return settled
    raise RuntimeError(f"replacements still met after {attempts} attempts")


def _rendered(mention: Column, kind: Column, replaced: Column) -> Column:
    """The replacement in the spelling of the mention: its digits and letters go where the mention has some."""
    kept = r"[ ().\-]"
    chars = F.split(mention, "")

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), kept, ""))
        return F.when(c.rlike(kept), c).otherwise(F.substr(replaced, before, F.lit(1)))

    spaced = F.array_join(F.transform(chars, one), "")
    cased = F.when(mention == F.upper(mention), F.upper(replaced)).otherwise(replaced)
    return F.when(kind.isin("email", "secret"), cased).when(kind.isin("ip", "given", "family"), replaced).otherwise(spaced)


def replace_personal_data(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text (with surrogates), n_mentions: every mention of an email, phone, card, IP, IBAN, secret or name replaced.

    One entity has one surrogate in all documents (keyed by ``key``, which is to be kept secret), different entities of a kind
    have different ones, and none equals an entity that occurs; known given names change places within their lists. In a
    document with a whole name its given and family names alone are mentions too. Numbers are cards only by their Luhn sum.
    Whole texts; a null text stays null, an empty one empty; rows that repeat are each returned; an empty table gives an
    empty result; other columns are not read.
    """
    body = F.col(f"`{text}`")
    seen = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(FIND), F.lit(0))), lambda m: _kind(m).isNotNull())
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"))
    # One look at all texts; what follows reads the mentions, and joins only texts that have some.
    every = cut(plain.withColumn("m", F.coalesce(seen, F.array().cast("array<string>"))))
    one = every.where("size(m) > 0").select("h1", "h2", F.explode("m").alias("mention")).withColumn("kind", _kind(F.col("mention")))
    names = one.where("kind = 'name'").withColumn("n", _name_words(F.col("mention")))
    words = names.select("h1", "h2", F.col("n.given").alias("mention"), F.lit("given").alias("kind")).where("mention is not null")
    words = words.union(names.select("h1", "h2", F.explode("n.family").alias("mention"), F.lit("family").alias("kind")))
    known = given_names(key)
    one = cut(one.where("kind != 'name'").union(words).withColumn("norm", _norm(F.col("mention"), F.col("kind"))).distinct())
    is_known = (F.col("kind") == "given") & F.col("norm").isin(*known)
    mapping = cut(distinct_surrogates(cut(one.where(~is_known).select("kind", "norm").distinct()), key))
    shown = one.join(mapping, ["kind", "norm"]).select("h1", "h2", "mention", "kind", _rendered(F.col("mention"), F.col("kind"), F.col("surrogate")).alias("by"))
    swapped = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("mention"))
    shown = shown.union(one.where(is_known).select("h1", "h2", "mention", "kind", swapped.alias("by")))
    # A word that is a given name here and a family name there counts as a given name in this text.
    shown = shown.groupBy("h1", "h2", "mention").agg(F.max_by("by", "kind").alias("by"))
    by_text = cut(shown.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("mention", "by"))).alias("by")))
    # The same join at every size; AQE splits texts that very many documents share.
    joined = every.where("size(m) > 0").join(by_text.hint("shuffle_hash"), ["h1", "h2"])
    mentions, pieces = F.regexp_extract_all("text", F.lit(WEAVE), F.lit(0)), F.split("text", WEAVE, -1)
    by = lambda m: F.try_element_at(F.col("by"), m)
    new = lambda m: F.coalesce(by(m), F.array_join(F.transform(F.split(m, " "), lambda w: F.coalesce(by(w), w)), " "))
    woven = F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.col("news"), F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")
    changed = F.size(F.filter(F.zip_with("ms", "news", lambda m, n: m != n), lambda x: x)).cast("long")
    done = joined.withColumn("ms", mentions).withColumn("news", F.transform("ms", new)).select("doc_id", woven.alias("text"), changed.alias("n_mentions"))
    none = every.where("size(m) = 0").select("doc_id", "text", F.lit(0).cast("long").alias("n_mentions"))
    return none.union(done)
