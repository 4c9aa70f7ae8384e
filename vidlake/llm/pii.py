"""PII surrogates: every detected entity gets a keyed replacement of its own type and format.

The distinct entities of the corpus form a table; each gets a surrogate that a key and
an attempt number decide. One that is an entity of the corpus, or that another entity
already has, gets a further attempt, and attempts draw from ever longer surrogates,
so every entity finds a free one. Documents are then rewritten from that table, so an
entity reads alike wherever it occurs. DataFrame expressions only.

Names are the capitalised words after a title; where a document names somebody so, every
other mention of these words in it is replaced too. Telephone numbers are told apart
by their last ten digits, with or without a country's prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vidlake.llm.storage import drop, free_name, save

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
#: In three groups of which the last has four digits; or international, of 8 to 15 digits in groups of any length.
PHONE = (
    r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+(])\+(?=(?:[ .()-]{0,2}[0-9]){8,15}(?![0-9]))[0-9]{1,4}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,12}))+(?![0-9])"
)
CARD = r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])"
#: Titles that tell how a name's bearer is addressed.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Doña")
#: Titles that do not tell it.
OTHER_TITLES = ("Dr", "Prof", "Doctor", "Professor")
_TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
#: What may stand before a name's words and is no word of it.
PARTICLES = ("van", "von", "der", "den", "de", "di", "da", "del", "la", "le", "du", "dos")
_BEFORE = rf"(?:(?:(?:\p{{Lu}}\.)+|{'|'.join(PARTICLES)}) )*"
#: No title; an apostrophe or capital inside (O'Brien, McDonald), but no possessive.
_LETTERS = rf"(?!(?:{_TITLES}|{_TITLES.upper()})(?!\p{{L}}))" r"\p{Lu}\p{M}*(?:['’](?=\p{Lu}\p{L})|\p{L}\p{M}*)+"
_WORD = rf"{_LETTERS}(?:-{_LETTERS})?(?![\p{{L}}])"
#: A title, in this case or in capitals, and up to three words, with initials and particles between.
NAME = rf"(?<![\p{{L}}])(?:{_TITLES}|{_TITLES.upper()})\.? {_BEFORE}{_WORD}(?: {_BEFORE}{_WORD}){{0,2}}"
ENTITY = "|".join((EMAIL, IP, PHONE, CARD))
NAME_HINT = rf"(?<![\p{{L}}])(?:{_TITLES}|{_TITLES.upper()})\.? (?:\p{{Lu}}|(?:{'|'.join(PARTICLES)}) )"
#: Cheaper than ENTITY and NAME, and holds wherever one does.
HINT = "[0-9@]|" + NAME_HINT
#: Parts that surrogate names are put together from, by script.
SYLLABLES = ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo")
MALE_ENDS = ("n", "rd", "s", "k", "ld", "rt", "x", "m")
FEMALE_ENDS = ("a", "ia", "ina", "elle", "ie", "ena", "ora", "ys")
CYRILLIC = (("ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"), ("н", "рд", "с", "к", "лд", "рт", "в", "м"), ("а", "ия", "ина", "ова", "ева", "ена", "ора", "ая"))
GREEK = (("βα", "δε", "φι", "γο", "χα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βε", "θι", "ζο"), ("ς", "νος", "ρης", "κος", "λης", "τος", "ξ", "μης"), ("α", "ια", "ινα", "ελη", "ιη", "ενα", "ορα", "ου"))
#: Attempts that keep an entity's length; later ones add a letter, a digit or a syllable each.
SAME_LENGTH = 2


def named_words(text: Column) -> Column:
    """ARRAY<STRUCT<word, kind, form>>: the words of the names in a text, in lower case and as written, with the gender of their title (person where it tells none)."""
    def words(name: Column) -> Column:
        titled = lambda titles: F.lower(name).rlike("^(?:" + "|".join(titles).lower() + r")\.? ")
        kind = F.when(titled(MALE_TITLES), "male").when(titled(OTHER_TITLES), "person").otherwise("female")
        # initials and particles stay
        own = F.filter(F.split(name, " "), lambda w, i: (i > 0) & w.rlike(r"^\p{Lu}.*[^.]$"))
        return F.transform(own, lambda w: F.struct(F.lower(w).alias("word"), kind.alias("kind"), w.alias("form")))

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NAME), 0), words))
    return F.when(text.rlike(NAME_HINT), found).otherwise(F.array().cast("array<struct<word:string,kind:string,form:string>>"))


def pattern_of(names: Column) -> Column:
    """The regular expression of a document's entities: ENTITY, and its name words with a capital first, in capitals, or as a title had them."""
    words = F.array_distinct(F.transform(names, lambda n: n["word"]))
    written = F.transform(names, lambda n: n["form"])
    # the longest first: a word may start another
    ordered = F.transform(F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    # a word after a hyphen has its own capital
    forms = F.flatten(F.transform(ordered, lambda w: F.concat(F.array(F.array_join(F.transform(F.split(w, "-"), lambda p: F.initcap(p)), "-"), F.upper(w)), F.filter(written, lambda f: F.lower(f) == w))))
    forms = F.array_distinct(forms)
    bare = F.concat(F.lit(r"(?<![\p{L}])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}])"))
    return F.when(F.size(words) > 0, F.concat(F.lit(ENTITY + "|"), bare)).otherwise(F.lit(ENTITY))


def kind_of(entity: Column, names: Column) -> Column:
    own = F.filter(names, lambda n: n["word"] == F.lower(entity))
    gender = F.coalesce(F.get(F.filter(own, lambda n: n["kind"] != "person"), 0)["kind"], F.get(own, 0)["kind"])
    return (
        F.when(entity.contains("@"), "email").when(entity.rlike("^" + IP + "$"), "ip").when(entity.rlike("^" + CARD + "$"), "card")
        .when(entity.rlike(r"^\p{Lu}"), gender).otherwise("phone")
    )


def core_of(entity: Column, kind: Column) -> Column:
    """What tells two entities apart however they are written: lower case, or digits alone; of a telephone number the last ten."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind == "card", digits).when(kind == "phone", F.right(digits, F.lit(10))).when(kind == "ip", entity).otherwise(F.lower(entity))


def _pick(letters: Column, n: int, *seed: Column) -> Column:
    return F.substring(letters, F.pmod(F.xxhash64(*seed), F.lit(n)).cast("int") + 1, F.lit(1))


def _scrambled(core: Column, *seed: Column) -> Column:
    """Each digit becomes a digit and each letter a letter of the same script; marks stay."""
    def one(c: Column, i: Column) -> Column:
        at = [*seed, i]
        return (
            F.when(c.rlike("^[0-9]$"), _pick(F.lit("0123456789"), 10, *at)).when(c.rlike("^[a-z]$"), _pick(F.lit("abcdefghijklmnopqrstuvwxyz"), 26, *at))
            .when(c.rlike(r"^\p{IsCyrillic}$"), _pick(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), 27, *at))
            .when(c.rlike(r"^\p{IsGreek}$"), _pick(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), 24, *at))
            .when(c.rlike(r"^\p{Ll}$"), _pick(F.lit("áàâäãéèêëíìîïóòôöõúùûüñç"), 24, *at)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(core, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of a 16-digit number's digits, every second one doubled, modulo 10."""
    each = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def surrogate(kind: Column, core: Column, key: Column, attempt: Column) -> Column:
    """The replacement core: same kind, script, marks and, at first, length; valid octets and check digits; names by gender."""
    # a keyed digest; what is picked by it tells nothing about the key
    digest = F.sha2(F.concat_ws("\x1f", key, F.sha2(F.concat_ws("\x1f", key, attempt.cast("string"), kind, core), 256)), 256)
    more = F.greatest(attempt - (SAME_LENGTH - 1), F.lit(0))
    longer = lambda letters, n: F.array_join(F.transform(F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>")), lambda i: _pick(F.lit(letters), n, digest, F.lit("more"), i)), "")
    local = F.concat(_scrambled(F.substring_index(core, "@", 1), digest), longer("abcdefghijklmnopqrstuvwxyz", 26), F.lit("@"), F.substring_index(core, "@", -1))
    # beyond the valid octets there are a hundred times as many that only look like one
    top = F.when(more > 2, 999).otherwise(254)
    octets = F.array_join(F.transform(F.split(core, r"\."), lambda c, i: (F.pmod(F.xxhash64(digest, i), top) + 1).cast("string")), ".")
    card = F.concat(F.substring(core, 1, 1), _scrambled(F.substring(core, 2, 14), digest))
    check = ((10 - _luhn(F.concat(card, F.lit("0")))) % 10).cast("string")
    last = F.when(_luhn(core) == 0, check).otherwise(_pick(F.lit("0123456789"), 10, digest, F.lit(16)))
    phone = _scrambled(core, digest)

    def name(syllables: tuple, male: tuple, female: tuple) -> Column:
        part = lambda parts, n: F.get(F.array(*map(F.lit, parts)), F.pmod(F.xxhash64(digest, n), F.lit(len(parts))).cast("int"))
        many = F.array_join(F.transform(F.sequence(F.lit(1), more + 3), lambda i: part(syllables, i)), "")
        return F.concat(many, F.when(kind == "male", part(male, F.lit(-1))).when(kind == "person", part((*male, *female), F.lit(-1))).otherwise(part(female, F.lit(-1))))

    word = F.when(core.rlike(r"^\p{IsCyrillic}"), name(*CYRILLIC)).when(core.rlike(r"^\p{IsGreek}"), name(*GREEK)).otherwise(name(SYLLABLES, MALE_ENDS, FEMALE_ENDS))
    digits = longer("0123456789", 10)
    return F.when(kind == "email", local).when(kind == "ip", octets).when(kind == "card", F.concat(card, last, digits)).when(kind == "phone", F.concat(phone, digits)).otherwise(word)


def in_format_of(entity: Column, kind: Column, new: Column) -> Column:
    """The surrogate core written as the entity is: its case, its separators; what it is longer by comes last."""
    at = lambda text, i: F.substring(text, i, F.lit(1))
    size = F.length(entity)
    # the local part may be longer than the entity's; its case goes by place, and the domain's by place from the end
    local, old = F.substring_index(new, "@", 1), F.substring_index(entity, "@", 1)
    cased = F.array_join(F.transform(F.split(local, ""), lambda c, i: F.when(at(old, F.least(i + 1, F.length(old))).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")
    email = F.concat(cased, F.lit("@"), F.substring_index(entity, "@", -1))
    nth = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", ""))
    digits = F.length(F.regexp_replace(entity, "[^0-9]", ""))
    prefix = F.when(kind == "phone", F.greatest(digits - 10, F.lit(0))).otherwise(F.lit(0))
    filled = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("^[0-9]$") & (nth(i) > prefix), at(new, nth(i) - prefix)).otherwise(c)), "")
    number = F.concat(filled, F.substring(new, digits - prefix + 1, F.length(new)))
    name = F.when((entity == F.upper(entity)) & (size > 1), F.upper(new)).otherwise(F.initcap(new))
    return F.when(kind == "email", email).when(kind == "ip", new).when(kind.isin("card", "phone"), number).otherwise(name)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, core, new) for the distinct (kind, core) of entities: every new differs from the others and from every core of its kind.

    Of entities that come to the same surrogate in one attempt the smallest keeps it; the
    others, and those whose surrogate is a real entity or taken, go on to the next
    attempt alone. From the third attempt on surrogates grow, so some are free however
    many entities there are.
    """
    cores = save(entities.select("kind", "core").distinct(), "entities")
    waiting, settled, attempt = cores, [], 0
    while True:
        named = save(waiting.withColumn("new", surrogate(F.col("kind"), F.col("core"), F.lit(key), F.lit(attempt))), "named")
        if waiting is not cores:
            drop(waiting)
        good = named.groupBy("kind", "new").agg(F.min("core").alias("core"))
        good = good.join(cores.withColumnRenamed("core", "new").hint("merge"), ["kind", "new"], "left_anti")
        for taken in settled:
            good = good.join(taken.select("kind", "new").hint("merge"), ["kind", "new"], "left_anti")
        settled.append(save(good.select("kind", "core", "new"), "settled"))
        waiting = save(named.select("kind", "core").join(settled[-1].hint("merge"), ["kind", "core"], "left_anti"), "waiting")
        drop(named)
        attempt += 1
        if waiting.isEmpty():
            break
    drop(waiting)
    drop(cores)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs with a text whose entities are replaced, and n_entities (which replaces a column of that name).

    Entities: e-mail addresses (their domain stays) and IPv4 addresses, telephone and
    16-digit card numbers, and names: the words after a title, at every mention in the
    text. Null and empty texts stay as they are, with 0 entities; a text of any length is
    rewritten whole. Rows that repeat a doc_id, or have none, are rewritten each; other
    columns pass through, whatever their names. An empty table gives no rows. key: a
    secret; the same key gives the same surrogates for the same corpus. An entity that
    many documents have is one row of the table of surrogates; adaptive execution
    splits its join.
    """
    docs = docs.drop("n_entities")
    text = F.col("text").cast("string")
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    doc, mark, names, found, new = (free_name(docs, n) for n in ("doc", "mark", "names", "found", "new"))
    mentions = docs.where(hinted).select(F.col("doc_id").alias(doc), F.xxhash64("text").alias(mark), text.alias("text"), named_words(text).alias(names))
    mentions = mentions.withColumn(found, F.regexp_extract_all("text", pattern_of(F.col(names)), F.lit(0))).where(F.size(found) > 0)
    placed = mentions.select(doc, mark, names, F.posexplode(found).alias("at", "entity"))
    placed = placed.withColumn("kind", kind_of(F.col("entity"), F.col(names))).withColumn("core", core_of(F.col("entity"), F.col("kind")))
    placed = save(placed.select(doc, mark, "at", "entity", "kind", "core").distinct(), "placed")
    named = assign_surrogates(placed, key)
    written = placed.join(named.hint("merge"), ["kind", "core"]).withColumn("written", in_format_of(F.col("entity"), F.col("kind"), F.col("new")))
    lists = written.groupBy(doc, mark).agg(F.sort_array(F.collect_list(F.struct("at", "written"))).alias(new))
    lists = save(lists, "lists")
    drop(placed)
    own = free_name(docs, "own")
    touched = docs.where(hinted).withColumn(own, F.xxhash64("text"))
    rest = docs.where(~hinted).withColumn("n_entities", F.lit(0).cast("long"))
    both = touched.join(lists.hint("shuffle_hash"), touched["doc_id"].eqNullSafe(lists[doc]) & (F.col(own) == F.col(mark)), "left")
    pieces = F.split(text, pattern_of(named_words(text)))
    woven = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(new), i)["written"], F.lit("")))), "")
    done = both.withColumn("text", F.when(F.col(new).isNull(), text).otherwise(woven)).withColumn("n_entities", F.coalesce(F.size(new), F.lit(0)).cast("long"))
    return done.select(*docs.columns, "n_entities").unionByName(rest)
