"""Personal data: surrogate generation, in DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, payment cards, phone numbers, social security numbers, account numbers
(IBAN), secrets and names after a form of address. An entity's canonical form is its letters and digits in lower case, so
an address in capitals or a number with other separators is the same entity. Each distinct canonical form gets a keyed
surrogate, character by character: a digit for a digit, a hexadecimal digit for one in a secret, a letter of the same
script for a letter. What tells the type stays: octets of an IPv4 address stay octets, a card or account number stays valid
if it was, country codes of phone and account numbers, the beginnings of access tokens and top-level domains are kept. A name's first part
comes from a list for the gender of the form of address, each further part and a surname alone are spelled anew in their
script; particles in lower case (von, de la) stay. The occurrence's own signs and capitals are then put back, which keeps
its format.

A name is all that follows a form of address, one space between parts, as long as words begin with a capital: compound,
three-part, Mc and O' names, initials and names in capitals are read whole, and so are capitalised words right behind.

Surrogates are keyed by SHA-512 of key, kind, canonical form and attempt. Distinct entities that meet in one surrogate,
or in the canonical form of a real entity, are found by a combined count and all but the first try again, until there
are none; so distinct entities stay distinct, and equal ones equal across the corpus (coreference). Where the forms of a
length run out (two-letter surnames), later attempts are longer by a character each, so there always is a free one; only
addresses of four octets can't grow.

Entities are few and their table is made of distinct rows; only documents with entities are shuffled. The pattern runs over
texts that hold a sign of an entity (SIGNS): a digit, an @, the beginning of a token, a form of address.

Defined cases: null text counts as empty and is returned so; a text without entities is returned as it is; repeated rows
each get their row with equal surrogates; a null id is carried; other columns are ignored; an empty table gives an empty
result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import staged, whole_id

KEY = "strata-surrogates"
#: Attempts before surrogates grow, and before octets, which can't, are given up.
GROW, ATTEMPTS = 3, 200
WORD = r"[\p{L}\p{N}]"
#: Forms of address, which stand before a name and stay, with academic titles behind them.
TITLES = "Mrs|Mr|Ms|Miss|Herr|Frau|Señora|Señor|Sra|Sr|Madame|Monsieur|Mme|Mlle|Doña|Don|Dr|Prof|господин|госпожа|Господин|Госпожа"
ADDRESSED = rf"(?:{TITLES})\.? (?:(?:Dr|Prof)\.? |(?:med|phil|jur|rer|nat|habil|Ing)\. )*+"
#: Those that end a name before them; Miss and Don are names as well.
OTHERS = "|".join(t for t in TITLES.split("|") if t not in ("Miss", "Don", "Doña"))
#: Particles of names, which stay where they stand in lower case and another part follows.
PARTICLES = "von|vom|van|zu|zum|zur|der|den|de|del|della|degli|dei|di|da|das|do|dos|du|des|la|las|le|les|los|lo|el|al|bin|bint|ibn|ben|abu|ter|ten|te|af|av|y|e|i|und|auf|in|'t|ван|фон|де|ди|да|аль|ибн"
#: A part reaches to the end of the word: any letters, also behind an apostrophe or hyphen, but for a possessive 's.
PART = r"(?:(?:[dl]['’]|(?:al|el)-)?\p{Lu}[\p{L}\p{M}\p{N}]*+(?:['’-](?![sS](?![\p{L}\p{M}\p{N}]))[\p{L}\p{M}\p{N}]++)*+(?:(?<=(?<![\p{L}\p{M}\p{N}])\p{Lu})\.(?= ?\p{Lu}))?+)"
NAME = rf"(?:(?:{PARTICLES}) )*+{PART}(?: ?(?<=\.){PART}| (?!(?:{OTHERS})(?![\p{{L}}\p{{N}}]))(?:(?:{PARTICLES}) )*+{PART})*+"
#: Kinds in the order in which they are tried at a position.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*+@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)*+(?<=\.\p{{L}}{{2,24}})",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?!\.?[\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){ADDRESSED}{NAME}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ADDRESS = rf"^{ADDRESSED}"
#: Stands in every text that ENTITY matches.
SIGNS = rf"[0-9@]|[a-fA-F]{{32}}|gh[pousr]_|sk-|A[KS]IA|(?=[MHFSDPгГ])(?:{TITLES})\.? "
#: Country calling codes of one and two digits (all others have three), and beginnings of access tokens.
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
TOKENS = "akia|asia|gh[pousr]|sk"
#: The gender that forms of address tell.
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mlle|Doña|[Гг]оспожа)\b"
MALE = r"^(?:Mr|Herr|Señor|Sr|Monsieur|Don|[Гг]осподин)\b"
FIRST = {
    "f": "anna clara elena eva greta hanna ida irma julia laura lena maria marta mina nora paula rosa sara sofia vera".split(),
    "m": "adam albert bruno carl david emil erik felix hugo ivan jonas karl leo marco martin oscar paul peter samuel victor".split(),
    "n": "alex ari casey dana jamie jordan kai kim lou max noel quinn rene robin sam sasha sky toni val yuri".split(),
    "cf": "анна вера галина дарья елена жанна зоя инна лидия мария надежда нина ольга полина раиса светлана софья тамара ульяна юлия".split(),
    "cm": "антон борис виктор глеб денис егор захар иван кирилл лев максим никита олег павел роман семён тимур фёдор юрий яков".split(),
}
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"


def kind(entity: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed([(n, p) for n, p in PATTERNS.items() if n != "name"]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def letters(entity: Column) -> Column:
    """Letters and digits in lower case; of a name all after the form of address, with ~ before particles."""
    name = F.lower(F.regexp_replace(F.regexp_replace(entity, ADDRESS, ""), rf"(?<![^ ])(?=(?:{PARTICLES}) )", "~"))
    return F.when(entity.rlike(ADDRESS), name).otherwise(F.lower(F.regexp_replace(entity, r"[^\p{L}\p{N}]", "")))


def canonical(entity: Column, of: Column) -> Column:
    """What makes two occurrences one entity. The dots of addresses count; a name counts with its gender."""
    gender = F.when(entity.rlike(FEMALE), "f").when(entity.rlike(MALE), "m").otherwise("n")
    return (
        F.when(of.isin("email", "ip"), F.lower(entity))
        .when(of == "name", F.concat(gender, F.lit(":"), letters(entity)))
        .when((of == "phone") & entity.startswith("+"), F.concat(F.lit("+"), letters(entity)))
        .otherwise(letters(entity))
    )


def drawn(digest: Column, at: Column, n: int | Column) -> Column:
    """A number below n from four hexadecimal digits of the digest, by position."""
    four = F.substring(digest, (F.pmod(at * 3, F.lit(124)) + 1).cast("int"), F.lit(4))
    return F.pmod(F.conv(four, 16, 10).cast("int"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def remainder(account: Column) -> Column:
    """An account number, its first four characters moved behind, as a number (a is 10), modulo 97."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(characters(moved), F.lit(0), lambda s, c: F.pmod(F.when(c.rlike("[a-z]"), s * 100).otherwise(s * 10) + value(c), F.lit(97)).cast("int"))


def from_list(words: str | list[str], at: Column) -> Column:
    return F.substring(F.lit(words), at + 1, F.lit(1)) if isinstance(words, str) else F.element_at(F.array(*map(F.lit, words)), at + 1)


def like(char: Column, digest: Column, at: Column, hexadecimal: Column) -> Column:
    """A lower-case character of the same kind; signs stay."""
    return (
        F.when(hexadecimal & char.rlike("^[0-9a-f]$"), from_list("0123456789abcdef", drawn(digest, at, 16)))
        .when(char.rlike("^[0-9]$"), from_list("0123456789", drawn(digest, at, 10)))
        .when(char.rlike("^[a-z]$"), from_list(LATIN, drawn(digest, at, 26)))
        .when(char.rlike(r"^\p{IsCyrillic}$"), from_list(CYRILLIC, drawn(digest, at, len(CYRILLIC))))
        .when(char.rlike(r"^\p{IsGreek}$"), from_list(GREEK, drawn(digest, at, len(GREEK))))
        .when(char.rlike(r"^\p{IsLatin}$"), from_list(ACCENTED, drawn(digest, at, len(ACCENTED))))
        .otherwise(char)
    )


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def listed(part: Column, at: Column, parts: Column) -> Column:
    """Whether a part of a canonical name is a first name: the first of several and neither particle nor initial."""
    return (at == 0) & (F.size(parts) > 1) & ~part.rlike(r"^~|^.$|\.")


def tried(todo: DataFrame, key: str, attempt: int) -> DataFrame:
    """kind, form and other: the canonical form that this attempt has for each entity. Steps are columns, so each is computed once."""
    of, form, digest, kept, rest, account, plain = map(F.col, ("kind", "form", "digest", "kept", "rest", "account", "plain"))
    grown = max(0, attempt - GROW + 1)
    spare = lambda letters: F.concat(F.lit(""), *(from_list(letters, drawn(digest, F.lit(50 + i), len(letters))) for i in range(grown)))
    like_form = F.array_join(F.transform(characters(form), lambda c, i: like(c, digest, i, F.col("hexadecimal"))), "")
    rows = todo.select("kind", "form", F.sha2(F.concat_ws("\x1f", F.lit(key), of, form, F.lit(str(attempt))), 512).alias("digest"), ((of == "secret") & form.rlike("^[0-9a-f]+$")).alias("hexadecimal"))
    beginning = (
        F.when(of == "phone", F.regexp_extract(form, rf"^(\+(?:{CALLING}|[0-9]{{1,3}}))", 1))
        .when(of == "secret", F.regexp_extract(form, f"^({TOKENS})", 1))
        .when(of == "iban", F.substring(form, 1, 4))
        .otherwise("")
    )
    rows = rows.withColumns({"spelt": like_form, "kept": beginning})
    more = F.when(form.rlike("[a-z]") & ~F.col("hexadecimal"), spare(LATIN)).otherwise(spare("0123456789"))
    rows = rows.withColumn("plain", F.concat(kept, F.substring("spelt", F.length(kept) + 1, F.length(form)), more))
    # Numbers that were valid get check digits that fit.
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string"))))
    card = F.when(F.call_function("luhn_check", form), F.concat(body, F.element_at(check, 1).cast("string"))).otherwise(plain)
    country, number = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    iban = F.when(remainder(form) == 1, F.concat(country, F.lpad((98 - remainder(F.concat(country, F.lit("00"), number))).cast("string"), 2, "0"), number)).otherwise(plain)
    top = F.regexp_extract(form, r"(\.\p{L}+)$", 1)
    email = F.concat(spare(LATIN), F.substring("spelt", F.lit(1), F.length(form) - F.length(top)), top)
    ip = F.array_join(F.transform(F.split(form, r"\."), lambda o, i: drawn(digest, i * 2 + 1, 256).cast("string")), ".")
    gender, cyrillic = F.substring(form, 1, 1), form.rlike(r"\p{IsCyrillic}")
    pick = lambda words: from_list(words, drawn(digest, F.lit(7), len(words)))
    first = (
        F.when(cyrillic & (gender == "f"), pick(FIRST["cf"]))
        .when(cyrillic, pick(FIRST["cm"]))
        .when(gender == "f", pick(FIRST["f"]))
        .when(gender == "m", pick(FIRST["m"]))
        .otherwise(pick(FIRST["n"]))
    )
    name = F.substring(form, F.lit(3), F.length(form))
    parts, own = F.split(name, " "), F.split(F.substring("spelt", F.lit(3), F.length(form)), " ")
    anew = lambda p, i: F.when(listed(p, i, parts), first).when(p.startswith("~"), p).otherwise(F.get(own, i))
    full = F.concat(gender, F.lit(":"), F.array_join(F.transform(parts, anew), " "), F.when(cyrillic, spare(CYRILLIC)).otherwise(spare(LATIN)))
    other = F.when(of == "email", email).when(of == "iban", iban).when(of == "ip", ip).when(of == "card", card).when(of == "name", full).otherwise(plain)
    return rows.select("kind", "form", other.alias("other"))


def dressed(entity: Column, of: Column, form: Column) -> Column:
    """The surrogate form in the dress of an occurrence: its signs, and capitals where it has them."""
    upper = entity.rlike(r"\p{Lu}") & ~entity.rlike(r"\p{Ll}")
    address = F.regexp_extract(entity, f"({ADDRESS})", 1)
    parts, own = F.split(F.substring(form, F.lit(3), F.length(form)), " "), F.split(F.regexp_replace(entity, ADDRESS, ""), " ")
    capitals = lambda p, o: F.array_join(F.transform(characters(p), lambda c, i: F.when(F.substring(o, i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    worn = lambda p, i: (
        F.when(p.startswith("~"), F.substring(p, F.lit(2), F.length(p)))
        .when(F.get(own, i).rlike(r"\p{Lu}.*\p{Lu}") & ~F.get(own, i).rlike(r"\p{Ll}"), F.upper(p))
        .when(listed(p, i, parts), F.initcap(p))
        .otherwise(capitals(p, F.get(own, i)))
    )
    name = F.concat(address, F.array_join(F.transform(parts, worn), " "))
    bare = F.when(of == "phone", F.ltrim(form, F.lit("+"))).otherwise(form)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(
        c.rlike(f"^{WORD}$"),
        F.struct(F.concat(s["out"], F.when(c.rlike(r"^\p{Lu}$"), F.upper(F.substring(bare, s["at"], F.lit(1)))).otherwise(F.substring(bare, s["at"], F.lit(1)))).alias("out"), (s["at"] + 1).alias("at")),
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    signs = F.aggregate(characters(entity), start, step, lambda s: F.concat(s["out"], F.substring(bare, s["at"], F.length(bare))))
    return F.when(of.isin("email", "ip"), F.when(upper, F.upper(form)).otherwise(form)).when(of == "name", name).when(upper, F.upper(signs)).otherwise(signs)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct kind, form. Returns kind, form, other: distinct within a kind and no real form."""
    real = staged(entities.select("kind", "form"), "entities")
    todo, done = real, None
    for attempt in range(ATTEMPTS):
        best = tried(todo, key, attempt).groupBy("kind", "other").agg(F.min("form").alias("first"))
        taken = real.select("kind", F.col("form").alias("other"))
        if done is not None:
            taken = taken.unionAll(done.select("kind", "other"))
        won = best.join(taken, ["kind", "other"], "left_anti").select("kind", F.col("first").alias("form"), "other")
        won = staged(won, "surrogates")
        done = won if done is None else done.unionAll(won)
        todo = staged(todo.join(won, ["kind", "form"], "left_anti"), "collisions")
        if todo.isEmpty():
            return done
    raise RuntimeError(f"surrogates: addresses still meet after {ATTEMPTS} attempts, so nearly all of them are real")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per row: doc_id, text (with surrogates), n_entities."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(whole_id().alias("doc_id"), text.alias("text"))
    signs = F.col("text").rlike(SIGNS)
    has = signs & F.col("text").rlike(ENTITY)
    found = F.regexp_extract_all("text", F.lit(f"({ENTITY})"), F.lit(1))
    # id and salt tell documents apart; rows that agree in both have equal texts and so equal entities.
    told = lambda rows: rows.withColumns({"id": F.coalesce("doc_id", F.lit(-(1 << 63))), "salt": F.xxhash64("text")})
    of = told(docs.where(signs)).select("id", "salt", F.explode(F.array_distinct(found)).alias("entity"))
    of = of.withColumn("kind", kind(F.col("entity"))).withColumn("form", canonical(F.col("entity"), F.col("kind")))
    of = staged(of.distinct(), "occurrences")
    known = surrogates(of.select("kind", "form").distinct(), key)
    worn = of.join(known, ["kind", "form"]).select("id", "salt", "entity", dressed(F.col("entity"), F.col("kind"), F.col("other")).alias("other"))
    maps = worn.groupBy("id", "salt").agg(F.map_from_entries(F.collect_list(F.struct("entity", "other"))).alias("map"))  # a document's own
    held = told(docs.where(has)).join(maps, ["id", "salt"]).withColumn("found", found)
    gaps = F.split("text", ENTITY, -1)
    put = F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.try_element_at(F.col("map"), F.get(F.col("found"), i)), F.lit("")))), "")
    changed = held.select("doc_id", put.alias("text"), F.size("found").cast("long").alias("n_entities"))
    return changed.unionAll(docs.where(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))
