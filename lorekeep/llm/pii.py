"""PII: detected entities get keyed surrogates of their own type, script and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, quoted, saved

#: Titles that announce a person's name, and the gender that they tell (fixed values).
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "г-жа")
TITLES_M = ("Mr", "Herr", "Monsieur", "Sr", "г-н")
TITLES = TITLES_F + TITLES_M + ("Dr", "Prof")
#: Given names that surrogates draw from, by script and gender (fixed values).
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Flora Greta Hanna Irene Julia Klara Laura Maria Nora Olivia Paula Rosa Sara".split(),
    ("latin", "m"): "Adam Bruno Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Oskar Paul Robert".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
}
#: More given names that announce a name without a title (fixed values).
MORE_F = "Alice Amy Barbara Carmen Charlotte Claire Elizabeth Emily Emma Eva Helen Isabel Jane Jennifer Jessica Karen Linda Lisa Lucy Marie Mary Monica Nancy Patricia Petra Sandra Sarah Sofia Sophie Susan Ursula".split()
MORE_M = "Andrew Anthony Antonio Bernd Charles Daniel Edward François Frank George Hans Heinz Henry Jack Jacques James Jean John José Joseph Juan Klaus Luis Mark Matthew Michael Miguel Pablo Pedro Peter Philippe Pierre Richard Stefan Thomas Walter William Wolfgang".split()
FEMALE = tuple(GIVEN["latin", "f"] + GIVEN["cyrillic", "f"] + MORE_F)
MALE = tuple(GIVEN["latin", "m"] + GIVEN["cyrillic", "m"] + MORE_M)
WORD = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*"


def branches(words: tuple[str, ...]) -> str:
    """An alternation of words that looks at a first letter once."""
    by = {c: sorted({w[1:] for w in words if w[0] == c}) for c in sorted({w[0] for w in words})}
    return "|".join(f"{c}(?:{'|'.join(tails)})" for c, tails in by.items())


#: Shapes in the order in which they are tried at a place of the text.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z_-])(?:sk-[0-9A-Za-z_-]{16,}+|A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[opsu]_[0-9A-Za-z]{36,}+|xox[abprs]-[0-9A-Za-z-]{10,}+)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "card": r"(?<![\d.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)",
    "name": rf"(?<![\p{{L}}])(?=[\p{{Lu}}г])(?:(?:{branches(TITLES)})\.? {WORD}(?: {WORD})?|(?:{branches(FEMALE + MALE)}) {WORD})",
}
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())
#: Texts without any of these have no entity.
HINT = r"[0-9@]|sk-|gh[opsu]_|xox[abprs]-|A[KS]IA|(?<!\p{L})(?=[\p{Lu}г])(?:" + branches(TITLES + FEMALE + MALE) + r")[. ]"
NUMBERS = ("card", "ssn", "phone")
#: What a character is replaced by another of. In names, vowels stay vowels and consonants consonants.
PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = ("0123456789abcdef",)
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
#: The attempt from which surrogates grow by a character each time, and the last one.
WIDER, ROUNDS = 3, 40


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in SHAPES if k != "name"]):
        out = F.when(value.rlike(rf"^(?:{SHAPES[kind]})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity share: digits of numbers, addresses, hex secrets and surnames in lower case, a token as it stands."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(kind.isin(*NUMBERS), digits).when(kind.isin("email", "secret", "surname"), F.lower(value)).otherwise(value)


def nth(digest: Column, i: Column | int, size: int) -> Column:
    """The i-th number below ``size`` of a hex digest of 128 characters."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(32)) * 4 + 1
    return F.pmod(F.conv(F.substr(digest, at, F.lit(4)), 16, 10).cast("long"), F.lit(size)).cast("int")


def moved(alphabets: tuple[str, ...]):
    """Characters move on inside their own alphabet; all others stay."""

    def step(c: Column, i: Column, digest: Column) -> Column:
        out = c
        for letters in alphabets:
            at = F.instr(F.lit(letters), c)
            out = F.when((at > 0) & (c != ""), F.substr(F.lit(letters), F.pmod(at - 1 + nth(digest, i, 1 << 16), F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return out

    return step


def octet(c: Column, i: Column, digest: Column) -> Column:
    """A byte of an address; the first stays below 224, or from there on."""
    v, by = c.cast("int"), nth(digest, i, 1 << 16)
    first = F.when(v < 224, F.pmod(v + by, F.lit(224))).otherwise(224 + F.pmod(v - 224 + by, F.lit(32)))
    return F.when(i == 0, first).otherwise(F.pmod(v + by, F.lit(256))).cast("string")


def permuted(parts: Column, tweak: Column, step, rounds: int = 4) -> Column:
    """A keyed permutation of arrays of parts: a Feistel network whose halves are shifted, part by part, by a digest of the other.

    Every part stays in its alphabet, so distinct values of a format get distinct surrogates of that format.
    """
    half = lambda a: F.floor(F.size(a) / 2).cast("int")

    def turn(r: int, left: bool):
        def one(state: Column) -> Column:
            other = F.slice(state, half(state) + 1, F.size(state)) if left else F.slice(state, F.lit(1), half(state))
            digest = F.sha2(F.concat_ws("\x1f", tweak, F.lit(str(r)), F.array_join(other, "\x1e")), 512)
            now = lambda i: (i < half(state)) if left else (i >= half(state))
            return let(digest, lambda d: F.transform(state, lambda c, i: F.when(now(i), step(c, i, d)).otherwise(c)))

        return one

    for r in range(rounds):
        parts = let(parts, turn(r, r % 2 == 0))
    return parts


def pick(words: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index)


def luhn(digits: Column) -> Column:
    """The check sum of a card number, modulo ten."""
    n = F.char_length(digits)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.split(digits, ""), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, twice(c.cast("int"))).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return F.pmod(F.aggregate(parts, F.lit(0), lambda a, b: a + b), F.lit(10))


def surrogate(kind: Column, canon: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The keyed replacement in canonical form. From attempt WIDER on it is longer than the format, so that no format is ever full."""
    tweak = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"))
    whole = lambda text, alphabets, t=tweak: F.array_join(permuted(F.split(text, ""), t, moved(alphabets)), "")
    extra = F.greatest(attempt - WIDER + 1, F.lit(0))
    digest = F.sha2(F.concat_ws("\x1f", tweak, canon), 512)
    more = lambda letters: let(digest, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: F.when(i <= extra, F.substr(F.lit(letters), nth(d, i, len(letters)) + 1, F.lit(1))).otherwise("")), ""))

    domain = F.substring_index(canon, "@", -1)
    host = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    # a domain's own surrogate doesn't depend on the attempt, so that its addresses stay together
    email = F.concat(
        whole(F.substring_index(canon, "@", 1), PLAIN, F.concat_ws("\x1f", tweak, domain)), more(PLAIN[1]), F.lit("@"),
        whole(host, PLAIN, F.concat_ws("\x1f", F.lit(key), F.lit("domain"))), F.lit("."), F.substring_index(canon, ".", -1),
    )
    ip = F.array_join(permuted(F.split(canon, r"\."), tweak, octet), ".")
    number = F.concat(F.substr(canon, F.lit(1), F.lit(1)), whole(F.substr(canon, F.lit(2)), PLAIN), more(PLAIN[0]))
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), whole(F.substr(canon, F.lit(2), F.char_length(canon) - 2), PLAIN))
    card = let(body, lambda b: F.concat(b, F.pmod(luhn(canon) - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    card = F.concat(card, more(PLAIN[0]))  # the check sum, right or wrong, is that of the number itself
    lead = F.regexp_extract(canon, r"^(sk-|A[KS]IA|gh[opsu]_|xox[abprs]-)", 1)
    token = F.concat(lead, whole(F.substr(canon, F.char_length(lead) + 1), PLAIN), more(PLAIN[1]))
    surname = F.concat(whole(canon, LETTERS), F.when(canon.rlike(r"\p{IsCyrillic}"), more(LETTERS[4])).otherwise(more(LETTERS[0])))

    def given(script: str) -> Column:
        # one name, then two, then three: sixteen times as many people of one surname each time
        names = [F.when(gender == "f", pick(GIVEN[script, "f"], nth(digest, i, 16))).otherwise(pick(GIVEN[script, "m"], nth(digest, i, 16))) for i in range(ROUNDS // 8 + 1)]
        return F.array_join(F.slice(F.array(*names), F.lit(1), F.floor(attempt / 8).cast("int") + 1), "-")

    return (
        F.when(kind == "email", email)
        .when(kind == "secret", F.concat(whole(canon, HEX), more(HEX[0])))
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind.isin("ssn", "phone"), number)
        .when(kind == "token", token)
        .when(kind == "surname", surname)
        .when(canon.rlike(r"\p{IsCyrillic}"), given("cyrillic"))
        .otherwise(given("latin"))
    )


def in_format(kind: Column, value: Column, new: Column) -> Column:
    """Digits of ``new`` laid over those of ``value``, letters in the case of ``value``; other kinds are ``new`` as it is."""
    count = lambda i: F.char_length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), "[^0-9]", ""))
    laid = F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(new, count(i), F.lit(1))).otherwise(c))
    laid = F.concat(F.array_join(laid, ""), F.substr(new, F.char_length(F.regexp_replace(value, "[^0-9]", "")) + 1))
    capital = lambda i: F.substr(value, i + 1, F.lit(1)).rlike(r"\p{Lu}")
    mixed = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(capital(i), F.upper(c)).otherwise(c)), "")
    cased = F.when(~value.rlike(r"\p{Lu}"), new).when(~value.rlike(r"\p{Ll}"), F.upper(new)).otherwise(mixed)
    return F.when(kind.isin(*NUMBERS), laid).when(kind.isin("secret", "surname"), cased).otherwise(new)


def assign(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, new): distinct entities and distinct surrogates, none of which is itself an entity of the corpus.

    A surrogate is a keyed permutation of its entity's format, so the first draws are distinct. Those that are a
    real entity draw again with the next attempt, and the least of several that then meet stays; a surrogate that
    stays once stays for good. Given names are distinct among people of one surname. Formats widen, so draws end; only
    IP addresses can't, of which more than half would have to occur before ``rounds`` are not enough, which raises.
    """
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(None).cast("string"))
    state = entities.select("kind", "canon", "gender", F.lit(0).alias("attempt"), F.lit(False).alias("fixed"), F.lit(None).cast("string").alias("new"))
    real = entities.where("kind <> 'given'").select(F.col("kind").alias("_kind"), F.col("canon").alias("_canon"))
    of_one = F.when(F.col("kind") == "given", F.substring_index("canon", " ", -1)).otherwise("")
    for _ in range(rounds):
        drawn = state.withColumn("new", F.when(F.col("fixed"), F.col("new")).otherwise(surrogate(F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"), key)))
        order = Window.partitionBy("kind", "new", of_one).orderBy(F.desc("fixed"), "canon")
        ranked = drawn.withColumn("place", F.row_number().over(order))
        ranked = ranked.join(real, (F.col("kind") == F.col("_kind")) & (F.col("new") == F.col("_canon")), "left")
        good = F.col("fixed") | ((F.col("place") == 1) & F.col("_canon").isNull())
        state = saved(ranked.select("kind", "canon", "gender", F.when(good, F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"), good.alias("fixed"), "new"))
        if state.where(~F.col("fixed")).isEmpty():
            return state.select("kind", "canon", "new")
    raise RuntimeError("surrogates still collide; the space of a format is too small for its entities")


def slots(kind: Column, value: Column) -> Column:
    """A mention's parts, each with its own surrogate: one for most kinds, for names the given name and the surname.

    (slot, lead, kind, canon, value, gender): ``lead``, a title, stays in front.
    """
    title = F.regexp_extract(value, rf"^((?:{'|'.join(TITLES)})\.? )", 1)
    rest = F.substr(value, F.char_length(title) + 1)
    words, plain = F.split(rest, " "), F.regexp_replace(title, r"[. ]+$", "")
    first, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    gender = F.when(plain.isin(*TITLES_F), "f").when(plain.isin(*TITLES_M), "m").when(first.isin(*FEMALE), "f").when(first.isin(*MALE), "m")
    part = lambda slot, lead, k, canon, v, g: F.struct(F.lit(slot).alias("slot"), lead.alias("lead"), k.alias("kind"), canon.alias("canon"), v.alias("value"), g.cast("string").alias("gender"))
    none, surname = F.lit(""), F.lit("surname")
    person = F.concat_ws(" ", first, F.lower(last))
    full = F.array(part(0, title, F.lit("given"), person, first, gender), part(1, none, surname, canonical(surname, last), last, F.lit(None)))
    alone = F.array(part(0, title, surname, canonical(surname, last), last, F.lit(None)))
    other = F.array(part(0, none, kind, canonical(kind, value), value, F.lit(None)))
    return F.when(kind != "name", other).when(F.size(words) > 1, full).otherwise(alone)


def replace_pii(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace every entity in ``text_col``; add n_entities and kinds (sorted, distinct).

    ``key`` is the secret on which surrogates depend; without it, that in the setting spark.lorekeep.pii.key is taken, and
    without either there is an error. One entity has one surrogate in all documents, whatever the mention's format,
    and two entities have two. Addresses, numbers, IP addresses, hex secrets, tokens of known prefixes, titled names and
    names that begin with a known given name are found. A surrogate keeps the format, a card number whether its
    check digit is right, a name its title, gender and script, an address its domain's identity; a surname has one surrogate
    with and without title and given name. Null texts stay null, texts without entities are unchanged; rows that
    share an id are told apart by their texts. Columns of the input that have a result's name are replaced.
    """
    key = key or docs.sparkSession.conf.get("spark.lorekeep.pii.key", None)
    if not key:
        raise ValueError("give a key, or set spark.lorekeep.pii.key")
    docs = docs.drop("n_entities", "kinds")
    hot, found, mentions, spot, kind, value, rid, h1, h2, new, parts, salt, j1, j2, kinds, dkind, dcanon, dsalt = fresh(
        docs, "_hot", "_found", "_mentions", "_spot", "_kind", "_value", "_rid", "_h1", "_h2", "_new", "_parts", "_salt", "_j1", "_j2", "_kinds", "_dkind", "_dcanon", "_dsalt"
    )
    text = quoted(text_col)
    none = F.array().cast("array<string>")
    all_found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)
    marked = docs.withColumn(found, F.coalesce(all_found, none))
    clean = marked.where(F.size(found) == 0)  # most documents: they go nowhere
    marked = marked.where(F.size(found) > 0).withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit(1), text)})
    hits = docs.select(quoted(id_col).alias(rid), F.xxhash64(text).alias(h1), F.xxhash64(F.lit(1), text).alias(h2), F.posexplode(all_found).alias(spot, value))
    hits = hits.withColumn(kind, kind_of(F.col(value)))
    hits = saved(hits.select(rid, h1, h2, spot, F.col(kind).alias("of"), F.inline(slots(F.col(kind), F.col(value)))))
    entities = hits.groupBy("kind", "canon").agg(F.min("gender").alias("gender"))
    copies = 8  # a very frequent entity is dealt to so many tasks
    drawn = assign(entities, key).select(F.col("kind").alias(dkind), F.col("canon").alias(dcanon), F.col("new").alias(new), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(dsalt))
    dealt = hits.withColumn(salt, F.pmod(F.xxhash64(h1, spot), F.lit(copies)).cast("int"))
    named = dealt.join(drawn, (F.col("kind") == F.col(dkind)) & (F.col("canon") == F.col(dcanon)) & (F.col(salt) == F.col(dsalt)))
    piece = F.struct("slot", F.concat("lead", in_format(F.col("kind"), F.col("value"), F.col(new))).alias(new))
    spots = named.groupBy(rid, h1, h2, spot, "of").agg(F.array_join(F.sort_array(F.collect_set(piece)).getField(new), " ").alias(new))
    per_doc = spots.groupBy(rid, F.col(h1).alias(j1), F.col(h2).alias(j2)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(spot, new))), lambda x: x[new]).alias(mentions), F.sort_array(F.collect_set("of")).alias(kinds)
    )
    joined = marked.join(per_doc, quoted(id_col).eqNullSafe(per_doc[rid]) & (F.col(h1) == F.col(j1)) & (F.col(h2) == F.col(j2)), "left")
    joined = joined.withColumn(parts, F.when(F.col(mentions).isNotNull(), F.split(text, ANY, -1)))
    woven = F.array_join(F.zip_with(F.col(parts), F.col(mentions), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    replaced = joined.select(
        *[F.when(F.col(mentions).isNull(), text).otherwise(woven).alias(c) if c == text_col else quoted(c) for c in docs.columns],
        F.size(found).cast("long").alias("n_entities"),
        F.coalesce(F.col(kinds), none).alias("kinds"),
    )
    same = clean.select(*[text.cast("string").alias(c) if c == text_col else quoted(c) for c in docs.columns], F.lit(0).cast("long").alias("n_entities"), none.alias("kinds"))
    return replaced.unionByName(same)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """The key is that of the session, or where it has none, as in a check on made-up documents, one that protects nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = spark.conf.get("spark.lorekeep.pii.key", "made-up documents only")
    return replace_pii(docs, key).select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
