"""Surrogates for personal data, in DataFrame functions only.

Detection. One regular expression finds e-mail addresses, phone and card numbers, IPv4 and IPv6 addresses, social
security numbers, IBANs, secrets (long hexadecimal runs with a digit, keys with known beginnings) and names after a title (whole words,
whatever their capitals, with apostrophes, hyphens, particles and initials; Latin, Cyrillic, Greek, Han and Arabic, where a name is two words at most).
A text is searched once, and only if it has a digit, an @ or a title at all. Names without a title are not found.

Replacement. Each entity is one or more atoms: (kind, canonical value), for instance a number without its spaces, an address in lower
case, one word of a name. An atom's surrogate is drawn from SHA-256 of the secret key, its kind and value, so it is the same
wherever the atom stands (coreference, also over documents) and can't be guessed without the key. It keeps kind and format: digits
stay digits, letters letters, signs and case stay, and so do a phone's country code, a card's first digit and whether its check digit
is right, an address's top-level domain, an IBAN's country. Names get names of the same script, given names of
the same gender. The title tells it; where a title doesn't (Dr), the gender that the same full name has elsewhere in the corpus is taken
(of two the female one), else names of either kind. Initials stay.

Collision check. Over all distinct atoms of the corpus, no two atoms of a kind may have one surrogate, and no surrogate may be an atom
that occurs. Those that fail (all but one of those that share one) draw again until none is left. From LONGER draws on a
surrogate gets two more characters for each, so that short values can't run out of free ones. Documents meet the outcome of redrawn
atoms by a join; if nothing had to be drawn again, there is none.

Key. The session's setting spark.loomset.surrogate.key. Where it is unset, a random one is made and set, so that surrogates are the same
throughout a session, and can't be linked with those of another one.

Null texts stay null, empty ones empty, all other text stays as it is to the last character. Rows that repeat an id are replaced each.
Columns other than text pass unchanged, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import discard, keep, unused

KEY_SETTING = "spark.loomset.surrogate.key"
LONGER = 8
#: What is put around entities to part a text at them. Texts that have it already are parted by a second search.
MARK = "\u0001"

#: What is recognised. Every alternative begins where its kind of run begins, so that a long run is read once.
_EMAIL = r"(?<![._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,8}\.\p{L}{2,24}"
_IP = r"(?<![.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
_CARD = r"(?<![+.\-])(?:[0-9]{4}([ \-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5})(?![\p{L}\p{N}]|-[0-9])"
_NATIONAL = r"\([0-9]{3}\)[ ]?[0-9]{3}[ .\-]?[0-9]{4}|[0-9]{3}([ .\-])[0-9]{3}\2[0-9]{4}|0[0-9]{1,4}[ /\-][0-9]{3,4}[ \-]?[0-9]{3,5}"
_PHONE = rf"(?<![+])(?:\+[0-9]{{1,3}}[ .\-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[ .\-]?[0-9]{{2,4}}){{2,4}}|{_NATIONAL})(?![0-9])"
_IPV6 = r"(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
_SSN = r"(?<![\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2}[ ]?[0-9]{4}(?:[ ]?[A-Z0-9]{4}){0,4}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_HEXADECIMAL = r"(?=[a-fA-F]*+[0-9])(?:0x)?[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])"
_SECRET = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z\-]{20,}+|xox[abpr]-[0-9A-Za-z\-]{10,}+)(?![\p{L}\p{N}])"
#: A word of a name is a whole run of letters with a capital, also all capitals, an inner one, apostrophes and hyphens (McDonald, O'Brien).
_MALE, _FEMALE, _ANY = "Mr|Herr|Herrn|Monsieur|Señor|Sir|Господин|Κύριος", "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Госпожа|Κυρία", "Dr|Prof|Professor"
_ARABIC_MALE, _ARABIC_FEMALE = "السيد|الأستاذ|الدكتور", "السيدة|الأستاذة|الدكتورة"
_PARTICLES = "van|von|der|den|de|del|della|di|da|do|dos|das|du|la|le|los|bin|ibn|ben|ter|ten|zu|zur|zum|af|av|y|e|und"
_WORD = r"(?:[dl]['’]|[ae]l-)?(?=\p{Lu}['’\-]?[\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{Lu}[\p{L}\p{M}]*+|-\p{L}[\p{L}\p{M}]*+)*+"
_INITIALS = r"(?:\p{Lu}\.)+(?:-\p{Lu}\.)?"
_HAN = r"\p{IsHan}{2,4}+"
_CAPITALS = f"{_MALE}|{_FEMALE}|{_ANY}".upper()
_PERSON = (
    rf"(?:{_MALE}|{_FEMALE}|{_ANY})\.?[ ](?:(?:(?:{_PARTICLES}|{_INITIALS}|{_WORD})[ ]){{0,6}}{_WORD}|{_HAN})"
    rf"|(?:{_CAPITALS})\.?[ ](?:(?:{_INITIALS}|{_WORD})[ ])?{_WORD}|(?:{_ARABIC_FEMALE}|{_ARABIC_MALE})[ ]\p{{IsArabic}}{{2,}}+(?:[ ]\p{{IsArabic}}{{2,}}+)?"
)
#: All of them begin where no letter or digit stands before; those that begin with a digit or a sign are tried there alone.
ENTITY = rf"(?<![\p{{L}}\p{{N}}])(?:{_EMAIL}|{_IPV6}|(?=[0-9(+])(?:{_IP}|{_CARD}|{_SSN}|{_PHONE})|{_IBAN}|{_HEXADECIMAL}|{_SECRET}|(?=[DFHMPSГΚا])(?:{_PERSON}))"
#: All entities but names and secrets with a known beginning have one of the first; names have a title.
_SIGNS = "[@0-9]"
_TITLE = rf"(?<![\p{{L}}\p{{N}}])[DFHMPSГΚا](?:{'|'.join(x[1:] for x in f'{_MALE}|{_FEMALE}|{_ANY}|{_CAPITALS}|{_ARABIC_FEMALE}|{_ARABIC_MALE}'.split('|'))})\.?[ ]\p{{L}}"
_BEGINNINGS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-")

#: Beginnings and endings that surrogate names are put together from, by script.
_NAMES = {
    "latin": ("ba be bi bo da de di do fa fi ga ge ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(), ["n", "r", "s", "k"], ["na", "la", "ra", "ia"], ["ner", "son", "man", "berg", "ley", "well", "ton", "hart"]),
    "cyrillic": ("ба бе ва ве га да де ди за зо ка ки ла ле ли ло ма ме ми мо на не ни но па по ра ре ро са се та те ти то фе".split(), ["н", "р", "м", "й"], ["на", "ла", "ра", "ия"], ["ко", "ин", "ов", "ев", "ский", "енко", "ник", "ук"]),
    "han": ("李王张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗".replace("", " ").split(), ["明", "伟", "强", "军", "杰", "磊", "勇", "涛"], ["芳", "娜", "敏", "静", "丽", "艳", "娟", "霞"], ["文", "平", "海", "波", "宁", "云", "龙", "清"]),
    "arabic": ("سا را نا ما لا با دا كا ها فا زا يا سي ري ني مي لي بي دي كي".split(), ["م", "ن", "ر", "د"], ["نة", "رة", "مة", "لة"], ["اوي", "اني", "وري", "ري", "دين", "ون", "ار", "ال"]),
    "greek": ("βα βε γα δα δι ζα θε κα κο λα λε μα με μι να νι πα πε ρα ρο σα σι τα τε φα φι".split(), ["ς", "ων", "ος", "ης"], ["να", "λα", "ρα", "ια"], ["ιδης", "ακης", "πουλος", "ου", "ογλου", "αρας", "εας", "ινος"]),
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _signs_out(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "")


def _chars(x: Column) -> Column:
    """The characters of a text, in one pass (a place in a text is found only by counting up to it)."""
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def _kind(x: Column) -> Column:
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike(rf"^(?:{_MALE}|{_FEMALE}|{_ANY}|{_CAPITALS}|{_ARABIC_FEMALE}|{_ARABIC_MALE})\.?[ ]"), "person")
        .when(x.rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f:]+$"), "ipv6")
        .when(x.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(x.rlike(r"^[0-9]{4}[0-9 \-]{11,15}$") & F.length(_digits(x)).isin(15, 16), "card")
        .when(x.rlike(r"^[+(0-9][0-9 ().\-]+$") & (F.length(_digits(x)) < 20), "phone")
        .when(x.rlike(r"^[A-Z]{2}[0-9]{2}") & (F.length(_signs_out(x)) <= 34) & ~x.rlike("^[0-9a-fA-F]{32,}$"), "iban")
        .otherwise("secret")
    )


def _part(kind: Column, canon: Column, raw: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), canon.cast("string").alias("canon"), raw.alias("raw"))


def _name_parts(x: Column) -> Column:
    """The title, signs, initials and particles, which stay (no kind), and the words of a name. The last word, and those joined to it by a hyphen, are the family's."""
    title = F.regexp_extract(x, r"^(\p{L}+\.? )", 1)
    bare = F.regexp_extract(x, r"^(\p{L}+)", 1)
    male, female = (f"^(?:{one}|{one.upper()}|{other})$" for one, other in ((_MALE, _ARABIC_MALE), (_FEMALE, _ARABIC_FEMALE)))
    given_kind = F.when(bare.rlike(male), "given_m").when(bare.rlike(female), "given_f").otherwise("given")
    given = F.regexp_extract(x, r"^\p{L}+\.? (.*[ ])?[\p{L}\p{M}'’\-]+$", 1)
    family = F.regexp_extract(x, r"([\p{L}\p{M}'’\-]+)$", 1)

    def words(text: Column, kind: Column) -> Column:
        named = lambda w: w.rlike(rf"^(?!(?:{_PARTICLES}|al|el)$)\p{{L}}[\p{{L}}\p{{M}}]+$")
        return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0)), lambda w: _part(F.when(named(w), kind), F.when(named(w), F.lower(w)), w))

    return F.concat(F.array(_part(F.lit(None), F.lit(None), title)), words(given, given_kind), words(family, F.lit("family")))


def _parts(some: DataFrame, row: str, pieces: str) -> DataFrame:
    """row, pos, part, kind, canon, raw and name (of persons): what the entities of each row are made of."""
    x, kind = F.col("x"), F.col("kind")
    canon = F.when(kind.isin("email", "secret", "ipv6"), F.lower(x)).when(kind == "phone", F.concat(F.when(x.startswith("+"), "+").otherwise(""), _digits(x))).when(kind == "iban", F.regexp_replace(x, " ", "")).when(kind == "ip", x).otherwise(_digits(x))
    found = F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: F.element_at(pieces, i + 1))
    entities = some.select(F.col(row).alias("row"), F.posexplode(found).alias("pos", "x")).withColumn("kind", _kind(x))
    parts = F.when(kind == "person", _name_parts(x)).otherwise(F.array(_part(kind, canon, x)))
    name = F.when(kind == "person", F.lower(F.regexp_replace(x, r"^\p{L}+\.? ", "")))
    return entities.select("row", "pos", name.alias("name"), F.posexplode(parts).alias("part", "p")).select("row", "pos", "part", "p.*", "name")


def _with_gender(parts: DataFrame) -> DataFrame:
    """Given names after a neutral title take the gender of the same full name elsewhere."""
    given = parts.filter(F.col("kind").isin("given", "given_m", "given_f")).select("name", "kind")
    known = given.groupBy("name").agg(F.bool_or(F.col("kind") == "given").alias("open"), F.min(F.when(F.col("kind") != "given", F.col("kind"))).alias("sex"))
    known = keep(known.filter("open AND sex IS NOT NULL").select("name", "sex"), "genders")
    if known.isEmpty():
        return parts
    return parts.join(known, "name", "left").withColumn("kind", F.when(F.col("kind") == "given", F.coalesce("sex", "kind")).otherwise(F.col("kind"))).drop("sex")


def _stream(key: Column, kind: Column, canon: Column, attempt: Column, length: Column) -> Column:
    """Pairs of hexadecimal digits, one for each of length places at least: blocks of a digest of the whole value, which is hashed once."""
    seed = F.sha2(F.concat_ws("\u0001", key, kind, canon, attempt.cast("string"), key).cast("binary"), 256)
    block = lambda one: lambda b: F.sha2(F.concat(one, F.lit(":"), b.cast("string")).cast("binary"), 256)
    joined = F.get(F.transform(F.array(seed), lambda one: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int")), block(one)), "")), F.lit(0))
    return F.regexp_extract_all(joined, F.lit(".."), F.lit(0))


def _number(pair: Column) -> Column:
    return F.conv(pair, 16, 10).cast("int")


def _pick(text: str, n: Column) -> Column:
    return F.substring(F.lit(text), F.pmod(n, F.lit(len(text))) + 1, F.lit(1))


def _luhn(digits: Column) -> Column:
    """The check sum of a digit text, modulo 10."""
    parts = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, F.floor(c.cast("int") * 2 / 10) + (c.cast("int") * 2) % 10).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10


def _redrawn_text(bare: Column, pairs: Column, hexadecimal: Column) -> Column:
    """Digits for digits and letters for letters. bare: not empty; pairs: as many at least."""

    def draw(both: Column) -> Column:
        n = _number(both["h"])
        return F.when(both["c"].rlike("[0-9]"), _pick("0123456789", n)).when(hexadecimal, _pick("abcdef", n)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", n))

    both = F.arrays_zip(_chars(bare).alias("c"), F.slice(pairs, F.lit(1), F.length(bare)).alias("h"))
    return F.array_join(F.transform(both, draw), "")


def _into_format(value: Column, plain: Column) -> Column:
    """Puts letters and digits into the places that value has for them, in its case; what is left over goes to the end."""
    placed = F.transform(_chars(value), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    holds = lambda x: x["c"].rlike(r"[\p{L}\p{N}]")
    own, signs, new = F.filter(placed, holds), F.filter(placed, lambda x: ~holds(x)), _chars(plain)
    cased = lambda a, c: F.struct(a["i"].alias("i"), F.coalesce(F.when(a["c"].rlike(r"\p{Lu}"), F.upper(c)).otherwise(c), F.lit("")).alias("c"))
    filled = F.zip_with(own, F.slice(new, F.lit(1), F.size(own)), cased)
    left = F.slice(new, F.size(own) + 1, F.greatest(F.size(new) - F.size(own), F.lit(0)))
    return F.array_join(F.concat(F.transform(F.array_sort(F.concat(filled, signs)), lambda x: x["c"]), left), "")


def _name(script: str) -> Column:
    begin, male, female, family = (F.array(*map(F.lit, x)) for x in _NAMES[script])
    pairs, kind = F.col("pairs"), F.col("kind")
    take = lambda x, i: F.element_at(x, F.pmod(_number(pairs[i]), F.size(x)) + 1)
    end = F.when(kind == "family", take(family, 9)).when((kind == "given_f") | (kind == "given") & (_number(pairs[10]) % 2 == 0), take(female, 9)).otherwise(take(male, 9))
    more = F.when(F.col("attempt") > LONGER, F.concat(take(begin, 11), take(begin, 12))).otherwise("")
    return F.concat(take(begin, 0), take(begin, 1), F.when(_number(pairs[8]) % 2 == 0, take(begin, 2)).otherwise(""), more, end)


def _drawn(atoms: DataFrame, secret: str) -> DataFrame:
    """Adds plain, the surrogate without signs (whole for names and IPv4 addresses). atoms: kind, canon, attempt and more."""
    key, kind, canon, attempt = F.lit(secret), F.col("kind"), F.col("canon"), F.col("attempt")
    other = [c for c in atoms.columns]
    fixed_left = (
        F.when(kind == "phone", F.when(canon.rlike(r"^\+1[0-9]{10}$"), 1).when(canon.startswith("+"), 2).otherwise(0))
        .when(kind == "card", 1)
        .when(kind == "iban", 2)
        .when(kind == "secret", F.length(_signs_out(F.regexp_extract(canon, "^(0x|akia|gh[pousr]_|sk-|xox[abpr]-)", 1))))
        .otherwise(0)
    )
    # an address is drawn in two pieces, as its domain has a surrogate of its own
    local = F.when(kind == "email", F.regexp_extract(canon, "^([^@]*)@", 1)).otherwise(canon)
    rows = atoms.select(
        *other,
        _signs_out(local).alias("bare"),
        fixed_left.alias("left"),
        F.when(kind == "email", F.regexp_extract(canon, r"@(.*)\.\p{L}+$", 1)).otherwise("").alias("domain"),
        F.when(kind == "email", F.regexp_extract(canon, r"\.(\p{L}+)$", 1)).otherwise("").alias("top"),
        ((kind == "secret") & canon.rlike("^(?:0x)?[0-9a-f]+$") | (kind == "ipv6")).alias("hexadecimal"),
    )
    more = 2 * F.greatest(attempt - LONGER, F.lit(0))
    rows = rows.select("*", _stream(key, kind, canon, attempt, F.length("bare") + more + 24).alias("pairs"), _stream(key, F.lit("domain"), F.col("domain"), F.lit(0), F.length("domain") + 1).alias("domain_pairs"))
    drawn = F.when(F.length("bare") > 0, _redrawn_text(F.col("bare"), F.col("pairs"), F.col("hexadecimal"))).otherwise("")
    rows = rows.select("*", F.concat(F.substring(F.col("bare"), F.lit(1), F.col("left")), F.substring(drawn, F.col("left") + 1, F.length("bare"))).alias("drawn"))
    spare = F.when(attempt > LONGER, F.array_join(F.transform(F.slice("pairs", F.length("bare") + 1, more), lambda h: _pick("0123456789", _number(h))), "")).otherwise("")
    body = F.substring(F.col("drawn"), F.lit(1), F.length("drawn") - 1)
    checked = F.concat(body, F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    domain = F.when(_signs_out(F.col("domain")) != "", _redrawn_text(_signs_out(F.col("domain")), F.col("domain_pairs"), F.lit(False))).otherwise("")
    octets = F.concat_ws(".", *((F.pmod(_number(F.col("pairs")[i]), F.lit(254)) + 1).cast("string") for i in range(4)))
    script = F.when(canon.rlike("[\u0400-\u052f]"), _name("cyrillic")).when(canon.rlike("[\u0370-\u03ff]"), _name("greek")).when(canon.rlike(r"\p{IsHan}"), _name("han")).when(canon.rlike(r"\p{IsArabic}"), _name("arabic")).otherwise(_name("latin"))
    plain = (
        F.when(kind == "ip", F.concat(octets, F.when(attempt > LONGER, F.concat(F.lit("-"), spare)).otherwise("")))
        .when(kind.isin("given", "given_m", "given_f", "family"), script)
        .when(kind == "email", F.concat(F.col("drawn"), spare, domain, F.col("top")))
        .when(kind == "iban", F.upper(F.concat(F.col("drawn"), spare)))
        .when((kind == "card") & (_luhn(F.when(kind == "card", F.col("bare")).otherwise("0")) == 0), F.concat(checked, spare))
        .otherwise(F.concat(F.col("drawn"), spare))
    )
    return rows.select(*other, plain.alias("plain"))


_WHOLE = ("ip", "given", "given_m", "given_f", "family")


def _collisions(atoms: DataFrame, secret: str) -> DataFrame | None:
    """kind, canon and attempt of the atoms that had to be drawn again; None if there are none. atoms: kind and canon, distinct."""
    surrogate = F.when(F.col("kind").isin(*_WHOLE), F.col("plain")).otherwise(_into_format(F.col("canon"), F.col("plain")))
    real = atoms.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
    now = keep(_drawn(atoms.withColumn("attempt", F.lit(0)), secret).select("kind", "canon", "attempt", surrogate.alias("surrogate")), "surrogates")
    redrawn = False
    while True:
        # of those that share a surrogate one keeps it, an earlier draw before a later one: a partial aggregate, whatever shares it
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon"))["canon"].alias("holder"))
        again = F.col("real").isNotNull() | (F.col("canon") != F.col("holder"))
        marked = now.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        marked = keep(marked.select("kind", "canon", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.when(~again, F.col("surrogate")).alias("held")), "surrogates")
        if marked.filter("held IS NULL").isEmpty():
            return now.filter("attempt > 0").select("kind", "canon", "attempt") if redrawn else None
        redrawn = True
        now = keep(_drawn(marked, secret).select("kind", "canon", "attempt", F.coalesce("held", surrogate).alias("surrogate")), "surrogates")


def session_key(spark: SparkSession) -> str:
    """The session's secret key; a random one where none is set."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def _may_hold(text: Column) -> Column:
    """False for texts without any entity, by cheaper searches than that for entities."""
    out = text.rlike(_SIGNS) | text.rlike(_TITLE)
    for beginning in _BEGINNINGS:
        out |= text.contains(beginning)
    return out


def _pieces(text: Column) -> Column:
    """The text parted at its entities: those at odd places (from 0) are entities. Null if it has none."""
    fast = F.split(F.regexp_replace(text, ENTITY, f"{MARK}$0{MARK}"), MARK, -1)
    between, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    slow = F.concat(F.flatten(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.array(a, b))), F.slice(between, F.lit(-1), F.lit(1)))
    return F.when(_may_hold(text), F.when(text.contains(MARK), slow).otherwise(fast))


def replace(documents: DataFrame, key: str | None = None, count: bool = False) -> DataFrame:
    """The documents with surrogates in text, all other columns as they are; with count, n_entities is added. key: the session's if None."""
    key = key or session_key(documents.sparkSession)
    pieces, row, new, total = (unused(documents, x) for x in ("_pieces", "_row", "_new", "n_entities"))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    has = F.coalesce(F.size(pieces) > 1, F.lit(False))
    # a text with entities is kept in pieces alone
    marked = documents.withColumn("text", F.col("text").cast("string")).withColumn(pieces, _pieces(F.col("text")))
    marked = marked.select(*(F.when(~has, F.col("text")).alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in documents.columns), F.when(has, F.col(pieces)).alias(pieces))
    marked = keep(marked.withColumn(row, F.monotonically_increasing_id()), "entities")
    without = marked.filter(F.col(pieces).isNull()).select(*columns, *([F.lit(0).cast("long").alias(total)] if count else []))
    some = marked.filter(F.col(pieces).isNotNull())
    parts = keep(_parts(some, row, pieces), "parts")
    parts = _with_gender(parts)
    atoms = keep(parts.filter("kind IS NOT NULL").select("kind", "canon").distinct(), "atoms")
    again = _collisions(atoms, key)
    discard(atoms)
    parts = parts.withColumn("attempt", F.lit(0)) if again is None else parts.join(again, ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    drawn = _drawn(parts, key)
    value = F.when(F.col("kind").isNull(), F.col("raw")).when(F.col("kind") == "ip", F.col("plain")).when(F.col("kind").isin(*_WHOLE), F.when(F.col("raw").rlike(r"^\p{Lu}{2,}$"), F.upper("plain")).when(F.col("raw").rlike(r"^\p{Ll}"), F.col("plain")).otherwise(F.initcap("plain"))).otherwise(_into_format(F.col("raw"), F.col("plain")))
    # a row's parts are as many as its text has, and no more; both groupings want one shuffle
    parted = drawn.select("row", "pos", F.struct("part", value.alias("value")).alias("v")).repartition("row")
    entities = parted.groupBy("row", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["value"]), "").alias("value"))
    lists = entities.groupBy(F.col("row").alias(row)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"]).alias(new))
    text = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.element_at(new, (F.floor(i / 2) + 1).cast("int"))).otherwise(x)), "")
    replaced = [text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in documents.columns]
    with_ = some.join(lists, row).select(*replaced, *([F.size(new).cast("long").alias(total)] if count else []))
    return without.unionByName(with_)
