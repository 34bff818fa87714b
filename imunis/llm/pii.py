"""Personal data replaced by surrogates. DataFrame functions only.

Entities are found by one regular expression. Names are found by what stands
around them: a title, a known given name, or two capitalised words behind or
before a word that goes with a person (``BEFORE``, ``AFTER``); titles and given
names count in capitals as well. Each entity is replaced by a surrogate
that a keyed hash (SHA-512) makes from its kind and its normal form, so that the
same person, number or address gets the same surrogate everywhere, however it
is written. Surrogates are of the same kind and format:

  email    letters for letters, digits for digits, same lengths and case; the
           domain has a surrogate of its own, its last label stays
  phone    digits for digits, country code and punctuation stay; the digits
           are the same for each way to write the number
  card     digits for digits; valid by Luhn's formula if the original is
  ssn      digits for digits
  iban     country stays, digits for digits
  ip       another address
  secret   hexadecimal digits for hexadecimal digits, same length and case
  name     title stays; a given name of the same gender (or one that fits any,
           where the name does not tell) and script, the same for each mention; a surname of the same script (and grammatical
           gender), the same for each mention of the surname

Distinct entities must stay distinct: surrogates of all entities of the corpus
are compared, with each other and with the entities themselves, and all but one
of those that clash are drawn again, until none do. Given names are entities of
their own, compared with each other: with surnames distinct as well, two persons
never become one. A given name drawn again has one more part (Alma, Alma-Berta),
so there are as many as the corpus needs. The few drawn again are
joined to their documents; all others are replaced in place, without a shuffle
of the text.

Defined results
  null text      null, no entities.       empty text   empty, no entities.
  null doc_id    is a key like any other. repeated rows each give their row.
  ties           of overlapping matches the leftmost counts, then the order of
                 the pattern's kinds.
  empty table    gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imunis.llm.common import materialize

#: Titles and given names by gender, and surrogate names by script and gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"],
          "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"], "n": ["Dr", "Prof"]}
GIVEN = {"f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Maria", "Anna", "Marie",
               "Julie", "Sophie", "Claudia", "Ursula", "Carmen", "Lucia", "Мария", "Анна", "Елена", "Ольга"],
         "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Peter", "Jean",
               "Pierre", "Hans", "Klaus", "Carlos", "Juan", "José", "Иван", "Сергей", "Дмитрий", "Алексей"]}
SURROGATE_GIVEN = {
    ("latin", "f"): "Alma Berta Cora Dora Edda Flora Greta Hilda Irma Jutta Karla Lotta Mila Nora Olga Petra".split(),
    ("latin", "m"): "Arno Bruno Carl Dirk Egon Falk Georg Hugo Ivo Jens Kurt Lars Max Nils Otto Paul".split(),
    ("latin", "n"): "Alex Chris Dana Eden Flo Gale Harper Indy Jules Kim Lee Mika Noel Pat Quinn Robin".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Ева Жанна Зоя Инна Кира Лидия Майя Нина Полина Рита Софья Таня".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Тимур".split(),
}
_SYLLABLES = {"latin": "ba be bi bo da de di do ka ke ki ko la le li lo".split(),
              "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло".split()}

#: Calling codes: no code begins another one.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

#: Words before or behind two capitalised words that make them a person's name; fixed values, by language.
BEFORE = ("by with from named called contact dear hello hi thanks regards sincerely signed author met asked told "
          "von mit namens heiße heißt bin liebe lieber hallo grüße "
          "con llamo llama soy nombre querido querida hola saludos "
          "avec nommé nommée appelle suis cher chère bonjour").split()
AFTER = "said says wrote writes told asked lives works sagt sagte schreibt wohnt arbeitet dijo dice escribe vive trabaja dit écrit habite travaille".split()

_SP = r"[ \u00a0]{1,3}"


def _any_case(words: list[str]) -> str:
    """Words as written, or all in capitals."""
    return "|".join(w for word in words for w in dict.fromkeys((word, word.upper())))


_ALL_TITLES = _any_case([t for ts in TITLES.values() for t in ts])
_ALL_GIVEN = _any_case([n for ns in GIVEN.values() for n in ns])
_CAPITALIZED = r"\p{Lu}[\p{L}\p{M}'’\-]{1,40}"
#: A capital and small letters, as names are written in running text.
_PLAIN = r"\p{Lu}\p{Ll}{1,30}+"
_KINDS = [
    r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){0,8}(?<=\.\p{L}{2,24})",
    r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    r"(?<![\d+])\d(?:[ \-]?\d){12,18}(?!\d)",
    r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)",
    r"(?<![\d)])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)",
    r"(?<![\d.\-])\d{3}([.\-])\d{3}[.\-]\d{4}(?![\d\-])",
    r"(?<![\d.,+\-/])0\d{2,4}[ /\-]\d{5,7}(?![\d\-])",
    rf"(?<!\p{{L}})(?:(?:{_ALL_TITLES})\.?{_SP}{_CAPITALIZED}(?:{_SP}{_CAPITALIZED}){{0,2}}|(?:{_ALL_GIVEN}){_SP}{_CAPITALIZED})(?!\p{{L}})",
    rf"(?<=[ ,]){_PLAIN} {_PLAIN}(?!\p{{L}}| \p{{Lu}})(?<=(?:^|[^\p{{L}}])(?:{'|'.join(BEFORE)}),? \p{{Lu}}\p{{Ll}}{{1,30}} \p{{Lu}}\p{{Ll}}{{1,30}})",
    rf"(?<!\p{{L}}){_PLAIN} {_PLAIN}(?= (?:{'|'.join(AFTER)})(?!\p{{L}}))",
]
PATTERN = "|".join(f"(?:{k})" for k in _KINDS)
#: Rounds of drawing again; more would mean that a format has fewer values than the corpus has entities.
ROUNDS = 32
#: The draw of a name is its surname's plus so many times its given name's.
GIVEN_DRAW = 64


def kind_of(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (F.when(F.contains(m, F.lit("@")), "email").when(m.rlike(r"^[0-9A-Fa-f]{32,}$"), "secret")
            .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^\p{L}"), "name")
            .when(m.rlike(r"^\d") & (digits >= 13), "card").otherwise("phone"))


def normal(m: Column, kind: Column) -> Column:
    return (F.when(kind.isin("email", "secret", "ip"), F.lower(m)).when(kind == "iban", F.regexp_replace(m, " ", ""))
            .when(kind == "phone", F.regexp_replace(m, r"(?!^\+)\D", ""))
            .when(kind == "name", F.lower(F.regexp_extract(m, r"\S+$", 0))).otherwise(F.regexp_replace(m, r"\D", "")))


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _digits(h: Column) -> Column:
    return F.translate(h, "abcdef", "036925")


def _at(s: Column, i: Column) -> Column:
    return s.substr(i, F.lit(1))


def _fill(m: Column, digits: Column) -> Column:
    """``m`` with its n-th digit replaced by the n-th of ``digits``."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
        _at(m, i).rlike("[0-9]"), _at(digits, F.length(F.regexp_replace(m.substr(F.lit(1), i), r"[^0-9]", "")))
    ).otherwise(_at(m, i))), "")


def _letters(m: Column, h: Column) -> Column:
    """Letters for letters and digits for digits, case and the rest as they are."""
    alphabet = F.translate(h, "0123456789abcdef", "bcdfghjklmnprstv")
    turn = lambda i: F.pmod(i - 1, F.lit(128)) + 1
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
        _at(m, i).rlike("[0-9]"), _at(_digits(h), turn(i))).when(
        _at(m, i).rlike(r"\p{Lu}"), F.upper(_at(alphabet, turn(i)))).when(
        _at(m, i).rlike(r"\p{L}"), _at(alphabet, turn(i))).otherwise(_at(m, i))), "")


def _luhn(digits: Column, size: Column) -> Column:
    """Luhn's sum of the first digits of a number of ``size`` digits."""
    def add(total, i):
        d = _at(digits, i).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(F.pmod(size - i, F.lit(2)) == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(m: Column, h: Column) -> Column:
    own = F.regexp_replace(m, r"\D", "")
    size = F.length(own)
    body = _digits(h).substr(F.lit(1), size - 1)
    valid = F.pmod(_luhn(own, size), F.lit(10)) == 0
    check = F.pmod(-_luhn(body, size) + F.when(valid, 0).otherwise(1), F.lit(10))
    return _fill(m, F.concat(body, check.cast("string")))


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _digit(h: Column, at: int) -> Column:
    """The value, from 1 to 16, of a hexadecimal digit."""
    return F.conv(F.substring(h, at, 1), 16, 10).cast("int") + 1


def _pick(values: list[str], h: Column, at: int) -> Column:
    return F.element_at(_array(values), _digit(h, at))


def _parts(m: Column) -> tuple[Column, Column, Column]:
    """Title with its space, given names, surname."""
    title = F.regexp_extract(m, rf"^(?:{_ALL_TITLES})\.?{_SP}", 0)
    rest = m.substr(F.length(title) + 1, F.length(m))
    return title, F.regexp_extract(rest, rf"^(.*\S){_SP}\S+$", 1), F.regexp_extract(rest, r"\S+$", 0)


def _is_of(g: str, given: Column) -> Column:
    return given.rlike(rf"^(?:{_any_case(GIVEN[g])})(?!\p{{L}})")


def given_of(m: Column) -> Column:
    """Normal form of a name's given names, led by the kind of surrogate they get; empty if there are none.

    The kind goes by the given names alone, so that each mention, with
    whatever title, gets the same: the gender of a known name, of a Cyrillic
    one by its ending, and for all others a name that fits any.
    """
    def led(given: Column) -> Column:
        gender = (F.when(_is_of("f", given), "f").when(_is_of("m", given), "m")
                  .when(given.rlike(r"\p{IsCyrillic}"), F.when(given.rlike("[аяАЯ]$"), "f").otherwise("m")).otherwise("n"))
        return F.when(given == "", "").otherwise(F.concat(gender, F.lit(" "), F.lower(F.regexp_replace(given, _SP, " "))))

    return _let(_parts(m)[1], led)


def _given(m: Column, key: str, draw: Column) -> Column:
    """Surrogate of a name's given names: one of 16 at the first draw, one more part at each further one."""
    of = lambda script, g: _array(SURROGATE_GIVEN[script, g])

    def made(norm: Column) -> Column:
        gender, cyrillic = norm.substr(1, 1), norm.rlike(r"\p{IsCyrillic}")
        values = (F.when(cyrillic, F.when(gender == "f", of("cyrillic", "f")).otherwise(of("cyrillic", "m")))
                  .when(gender == "f", of("latin", "f")).when(gender == "m", of("latin", "m")).otherwise(of("latin", "n")))
        digits = _hash(key, F.lit("given"), norm, draw).substr(F.lit(1), draw + 1)
        return F.array_join(F.transform(F.split(digits, ""), lambda d: F.element_at(values, _digit(d, 1))), "-")

    return _let(given_of(m), made)


def _name(m: Column, h: Column, key: str, given_draw: Column) -> Column:
    def made(part: Column) -> Column:
        title, given, surname, own = (part[x] for x in ("title", "given", "surname", "own"))
        in_capitals = lambda word, new: F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(new)).otherwise(new)
        # Script and ending go by the surname alone, so that each mention gets the same.
        cyrillic = surname.rlike(r"\p{IsCyrillic}")
        ending = F.when(surname.rlike("[ая]$|[АЯ]$"), "ва").when(surname.rlike("[внй]$|[ВНЙ]$"), "в").otherwise("ко")
        new = F.initcap(F.concat(*[F.when(cyrillic, _pick(_SYLLABLES["cyrillic"], h, k)).otherwise(_pick(_SYLLABLES["latin"], h, k))
                                   for k in range(1, 6)]))
        new = F.concat(new, F.when(cyrillic, ending).otherwise("n"))
        return F.concat(title, F.when(given == "", "").otherwise(F.concat(in_capitals(given, own), F.lit(" "))), in_capitals(surname, new))

    title, given, surname = _parts(m)
    return _let(F.struct(title.alias("title"), given.alias("given"), surname.alias("surname"),
                         _given(m, key, given_draw).alias("own")), made)


def surrogate(m: Column, key: str, draw: Column) -> Column:
    """The surrogate of a match, at the given draw (0 unless it clashed; see ``GIVEN_DRAW``).

    Kind, normal form and hash are bound once: written out at each use, the
    expression would be too large to compile.
    """
    own_draw, given_draw = F.pmod(draw, F.lit(GIVEN_DRAW)), F.floor(draw / GIVEN_DRAW).cast("int")

    def hashed(kind: Column) -> Column:
        return _let(normal(m, kind), lambda norm: _let(_hash(key, kind, norm, own_draw), lambda h: made(kind, norm, h)))

    def made(kind: Column, norm: Column, h: Column) -> Column:
        local, domain = F.regexp_extract(m, r"^[^@]+", 0), F.regexp_extract(m, r"@(.*)$", 1)
        label, last = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.regexp_extract(domain, r"\.[^.]+$", 0)
        country = F.regexp_extract(norm, rf"^\+({CALLING})", 1)
        number = F.concat(country, _digits(h).substr(F.length(country) + 1, F.lit(128)))
        octet = [F.conv(F.substring(h, 2 * k + 1, 2), 16, 10) for k in range(4)]
        hexadecimal = F.repeat(h, F.ceil(F.length(m) / 128).cast("int")).substr(F.lit(1), F.length(m))
        site = _let(_hash(key, F.lit("domain"), F.lower(label)), lambda of_site: _letters(label, of_site))
        return (F.when(kind == "email", F.concat(_letters(local, h), F.lit("@"), site, last))
                .when(kind == "secret", F.when(F.upper(m) == m, F.upper(hexadecimal)).otherwise(hexadecimal))
                .when(kind == "ip", F.concat_ws(".", *octet))
                .when(kind == "card", _card(m, h))
                .when(kind == "name", _name(m, h, key, given_draw))
                .when(kind == "phone", _let(number, lambda number: _fill(m, number)))
                .otherwise(_fill(m, _digits(h))))

    return _let(kind_of(m), hashed)


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, norm, match): each different match of each row, and once more, of kind "given", names with given names."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(
        F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)))).alias("match"))
    found = found.withColumn("kind", kind_of(F.col("match"))).withColumn("norm", normal(F.col("match"), F.col("kind")))
    given = F.when(F.col("kind") == "name", given_of(F.col("match"))).otherwise("")
    own, more = F.struct("kind", "norm"), F.struct(F.lit("given").alias("kind"), given.alias("norm"))
    return (found.select("doc_id", "match", F.explode(F.when(given == "", F.array(own)).otherwise(F.array(own, more))).alias("entity"))
            .select("doc_id", "entity.kind", "entity.norm", "match"))


def draws(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, norm, draw): the entities whose surrogate had to be drawn again, and the draw that clashes with none."""
    known = materialize(mentions.groupBy("kind", "norm").agg(F.min("match").alias("match"))
                        .withColumn("draw", F.lit(0)), "entities")
    is_given = F.col("kind") == "given"
    # The rows are few and short, making a surrogate is the work: deal them out by number, not by size.
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(ROUNDS):
        known = known.repartition(tasks, "kind", "norm")
        made = surrogate(F.col("match"), key, F.when(is_given, F.col("draw") * GIVEN_DRAW).otherwise(F.col("draw")))
        drawn = materialize(
            known.withColumn("given", F.when(is_given, F.lower(_parts(made)[1])).otherwise(normal(made, F.col("kind")))), "surrogates")
        shared = drawn.groupBy("kind", "given").agg(F.min("norm").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        # A given name's normal form starts with the kind of its surrogate; one name may have several.
        real = drawn.select("kind", F.when(is_given, F.expr("substring(norm, 3)")).otherwise(F.col("norm")).alias("given"),
                            F.lit(True).alias("real")).distinct()
        judged = (drawn.join(shared.select("kind", "given", "keeper"), ["kind", "given"], "left")
                  .join(real, ["kind", "given"], "left")
                  .withColumn("clash", F.coalesce(F.col("keeper") != F.col("norm"), F.lit(False)) | F.col("real").isNotNull()))
        judged = materialize(judged.select("kind", "norm", "match", "draw", "clash"), "judged")
        if judged.filter("clash").isEmpty():
            return judged.filter("draw > 0").select("kind", "norm", "draw")
        known = judged.select("kind", "norm", "match", (F.col("draw") + F.col("clash").cast("int")).alias("draw"))
    raise RuntimeError("a kind of entity has more values in the corpus than its format has surrogates")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds (sorted); one row for each input row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    mentions = materialize(entities(base), "mentions")
    again = draws(mentions, key)
    if again.isEmpty():
        rows = base.withColumn("draws", F.lit(None).cast("map<string,int>"))
    else:
        name = F.concat_ws("\x1f", "kind", "norm")
        by_doc = (mentions.join(again, ["kind", "norm"]).select("doc_id", name.alias("name"), "draw").distinct()
                  .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "draw"))).alias("draws")))
        marked = by_doc.withColumnRenamed("doc_id", "marked")
        rows = base.join(marked, F.col("doc_id").eqNullSafe(F.col("marked")), "left").drop("marked")

    def put(m: Column) -> Column:
        kind = kind_of(m)
        drawn = lambda kind, norm: F.coalesce(
            F.try_element_at("draws", F.concat_ws("\x1f", kind, norm)), F.lit(0))
        given = F.when(kind == "name", drawn(F.lit("given"), given_of(m))).otherwise(0)
        draw = F.when(F.col("draws").isNull(), 0).otherwise(drawn(kind, normal(m, kind)) + given * GIVEN_DRAW)
        return _let(draw, lambda draw: surrogate(m, key, draw))

    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    rows = rows.withColumn("found", found)
    between = F.split("text", PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(
        between, F.transform("found", put), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return rows.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"),
                       F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_entities"),
                       F.array_sort(F.array_distinct(F.transform(F.coalesce("found", F.array().cast("array<string>")), kind_of)))
                       .alias("kinds"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every whole text of ``documents``, with a fixed key."""
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet"), "imunis-registered-query")
