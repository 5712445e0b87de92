"""Surrogates for personal data and secrets, with DataFrame functions only.

Entities are found by patterns. Each entity has a type and a canonical form (an
e-mail address in lower case, the digits of a phone number, ...), so all mentions
of one entity get one surrogate. The surrogate's characters come from a keyed
hash of (type, canonical form, attempt): a letter gives a letter of its script and
case, a digit a digit, and everything else stays, so the format is that of the
mention. Payment card numbers keep their first digit and a valid check digit,
account numbers their country and valid check digits, addresses their octets or
groups, and names are drawn from a list of the same gender and script. A long number
whose check digits are wrong is no card or account and stays as it is.

Collision checks. Over the distinct entities of all documents, a surrogate may
neither be an entity that occurs nor the surrogate of another entity; those that
are get the next attempt until none is left. Only entities that needed more than
the first attempt are joined back to their documents; all others get their
surrogate in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept

#: fixed values: titles before a name, by the gender they tell
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Г-жа", "Κα"),
          "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κος"),
          "n": ("Dr", "Prof")}
#: fixed values: names that replace names of the same gender and script
NAMES = {
    ("f", "latin"): "Alma Bella Clara Dora Edda Flora Greta Helga Irma Julia Karla Lena Mara Nora Olga Paula",
    ("m", "latin"): "Anton Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Konrad Leo Max Nils Otto Paul",
    ("n", "latin"): "Abel Berg Conrad Dorn Ebert Falk Gross Hahn Iversen Jung Kern Lang Moser Noll Ott Prinz",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья Юлия",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Макар Назар Олег Павел Роман Юрий",
    ("n", "cyrillic"): "Белый Волк Громов Дорн Ершов Жук Зимин Ильин Котов Левин Мороз Носов Орлов Панин Рыбак Чиж",
    ("f", "greek"): "Άννα Βάσω Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λίνα Μαρία Νίκη Όλγα Ρένα Σοφία Χαρά",
    ("m", "greek"): "Άρης Βασίλης Γιώργος Δήμος Ηλίας Θάνος Ίων Κώστας Λάμπρος Μάριος Νίκος Πάνος Ρένος Σπύρος Τάσος Φίλιππος",
    ("n", "greek"): "Αγγέλου Βλάχος Γαλανός Δούκας Ζήσης Ηλίου Θεού Ιωάννου Κόκκας Λέκκας Μήλιος Νίκας Πέππας Ράπτης Σάββας Χρήστου",
}
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_NAME = r"\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)?"
#: type -> pattern; an earlier type wins where two could start at the same place
PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]++@(?:[\w-]++\.)++\p{L}{2,}+",
    "secret": r"(?i:(?<![\p{L}\p{N}])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))"
              r" ?[=:] ?(?:\"[^\"\s]{6,}+\"|'[^'\s]{6,}+'|[^\s\"',;]{6,}+)",
    "cloud_key": r"(?<![\p{L}\p{N}])A(?:KIA|SIA)[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
           r"|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\p{L}\p{N}:]|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}])"
             r"|\+\d{8,15}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_NAME}",
}
ENTITY = "|".join(PATTERNS.values())
#: a text without any of these holds no entity
_HINT = rf"[0-9@]|(?i:password|passwd|pwd|secret|token|key) ?[=:]|(?:{_TITLE})\.? "
MAX_ROUNDS = 64


#: types whose surrogate takes the mention's spaces and marks
_DIGITS = ("card", "phone", "ssn", "iban")


def _mod97(code: Column) -> Column:
    """The remainder by 97 of an account number as ISO 13616 reads it: A is 10, B is 11, ..."""
    return F.aggregate(F.split(code, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), F.pmod(a * 10 + c.try_cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _turned(code: Column) -> Column:
    """The country and check digits behind the rest."""
    return F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))


def _kind(m: Column) -> Column:
    """Type of an entity from its text; ``number`` is a number that is none."""
    plain = F.regexp_replace(m, r"\D", "")
    digits = F.length(plain)
    return (F.when(m.rlike(r"(?i)^[a-z_-]+ ?[=:]"), "secret").when(m.contains("@"), "email")
            .when(m.rlike(r"^A[KS]IA"), "cloud_key").when(m.rlike(r"^\d+(\.\d+){3}$"), "ip")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^[0-9A-Fa-f:]+:[0-9A-Fa-f:]+$"), "ip6")
            .when(m.rlike(r"^[A-Z]{2}\d{2} ?[A-Z0-9]{4}"),
                  F.when(_mod97(_turned(F.replace(m, F.lit(" "), F.lit("")))) == 1, "iban").otherwise("number"))
            .when(m.rlike(r"^\p{L}"), "name")
            .when((digits >= 13) & m.rlike(r"^\d"), F.when(F.call_function("luhn_check", plain), "card").otherwise("number"))
            .otherwise("phone"))


def _lead(m: Column, kind: Column) -> Column:
    """The part of a mention that stays: a secret's name, a name's title."""
    return (F.when(kind == "secret", F.regexp_extract(m, r"^[^=:]+[=:] ?[\"']?", 0))
            .when(kind == "name", F.regexp_extract(m, rf"^(?:{_TITLE})\.? ", 0)).otherwise(""))


def _gender(lead: Column) -> Column:
    word = F.regexp_replace(lead, r"\.? $", "")
    return F.when(word.isin(*TITLES["f"]), "f").when(word.isin(*TITLES["m"]), "m").otherwise("n")


def _canonical(m: Column, kind: Column, lead: Column) -> Column:
    rest = F.substr(m, F.length(lead) + 1)
    return (F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(m, r"\D", ""))
            .when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind.isin("email", "ip6"), F.lower(m))
            .when(kind == "secret", F.regexp_replace(rest, r"[\"']$", ""))
            .when(kind == "name", F.concat(_gender(lead), F.lit(":"), rest)).otherwise(rest))


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """192 bytes, in hexadecimal, of the keyed hash."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}|{i}|"), F.sha2(seed, 512)), 512) for i in range(3)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(i, F.lit(192)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _reshape(text: Column, stream: Column, skip: Column) -> Column:
    """Every letter and digit after the first ``skip`` drawn anew within its class."""
    def draw(c, i):
        b = _byte(stream, i)
        nth = lambda alphabet: F.substr(F.lit(alphabet), F.pmod(b, F.lit(len(alphabet))) + 1, F.lit(1))
        cyrillic, greek = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
        return (F.when(i < skip, c).when(c.rlike(r"[0-9]"), nth("0123456789"))
                .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), F.upper(nth(cyrillic)))
                      .otherwise(nth(cyrillic)))
                .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), F.upper(nth(greek))).otherwise(nth(greek)))
                .when(c.rlike(r"\p{Lu}"), nth("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike(r"\p{L}"), nth("abcdefghijklmnopqrstuvwxyz")).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), draw), "")


def _hex_reshape(text: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.lower(F.conv(
        F.pmod(_byte(stream, i), F.lit(16)).cast("string"), 10, 16))), "")


def _luhn_digit(body: Column) -> Column:
    """The check digit that makes ``body`` a valid card number."""
    n = F.length(body)
    total = F.aggregate(F.split(body, ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), lambda a, d: F.struct(
        (a["i"] + 1).alias("i"),
        (a["s"] + F.when(F.pmod(n - a["i"], F.lit(2)) == 1, F.pmod(d.cast("int") * 2, F.lit(10))
                         + F.when(d.cast("int") > 4, 1).otherwise(0)).otherwise(d.cast("int"))).alias("s")),
        lambda a: a["s"])
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _pick_name(canon: Column, stream: Column) -> Column:
    gender, rest = F.substr(canon, F.lit(1), F.lit(1)), F.substr(canon, F.lit(3))
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").when(rest.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def of(k):
        out = F.lit(None).cast("string")
        for (g, s), names in NAMES.items():
            words = F.array(*[F.lit(x) for x in names.split()])
            out = F.when((gender == g) & (script == s), F.get(words, F.pmod(_byte(stream, F.lit(k)), F.lit(16)))).otherwise(out)
        return out
    # one word of the list for each word, and a drawn ending that keeps many names apart
    tail = F.lower(_reshape(F.regexp_replace(F.lower(rest), r"[ -].*", ""), stream, F.lit(0)))
    first = F.concat(of(60), F.substr(tail, F.lit(1), F.lit(3)))
    return F.when(rest.rlike("[ -]"), F.concat(first, F.regexp_extract(rest, "[ -]", 0), of(61))).otherwise(first)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value written and computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate."""
    return _let(_stream(kind, canon, attempt, key), lambda s: _form(kind, canon, attempt, s))


def _form(kind: Column, canon: Column, attempt: Column, s: Column) -> Column:
    more = F.when(attempt >= 8, F.substr(s, F.lit(300), F.least(attempt - 7, F.lit(40)))).otherwise("")  # small spaces
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (
        F.pmod(_byte(s, i) * 256 + _byte(s, i + 8), F.lit(254)) + 1).cast("string")), ".")
    body = F.substr(canon, F.lit(1), F.length(canon) - 1)
    card = _let(_reshape(body, s, F.lit(1)), lambda x: F.concat(x, _luhn_digit(x)))
    at = F.instr(canon, "@")
    domain_end = F.regexp_extract(canon, r"\.[^.]+$", 0)
    host = F.substr(canon, at + 1, F.length(canon) - at - F.length(domain_end))
    mail = F.concat(_reshape(F.substr(canon, F.lit(1), at - 1), s, F.lit(0)), more, F.lit("@"),
                    _reshape(host, F.reverse(s), F.lit(0)), domain_end)
    country = F.substr(canon, F.lit(1), F.lit(2))
    account = _let(_reshape(F.substr(canon, F.lit(5)), s, F.lit(0)), lambda x: F.concat(
        country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
    n = F.length(canon)
    keep = F.when(n > 10, n - 10).otherwise(0)  # a country code stays
    return (F.when(kind == "ip", octets).when(kind == "card", card)
            .when(kind == "iban", account)
            .when(kind == "ip6", F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(
                F.lower(F.conv((F.pmod(_byte(s, i), F.lit(15)) + 1).cast("string"), 10, 16)))), ""))
            .when(kind == "email", mail).when(kind == "phone", _reshape(canon, s, keep))
            .when(kind == "cloud_key", _reshape(canon, s, F.lit(4)))
            .when(kind == "name", _pick_name(canon, s))
            .when(kind == "ssn", _reshape(canon, s, F.lit(0)))
            .when(canon.rlike("^[0-9a-f]+$"), F.concat(_hex_reshape(canon, s), more))
            .otherwise(F.concat(_reshape(canon, s, F.lit(0)), more)))


def _render(m: Column, kind: Column, lead: Column, form: Column) -> Column:
    """A surrogate in the format of the mention ``m``."""
    kept_marks = F.when(kind == "iban", r" ").otherwise(r"\D")
    digits = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(
        c.rlike("[0-9]") | (kind == "iban") & (c != " "),
        F.substr(form, F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), kept_marks, F.lit(""))), F.lit(1)))
        .otherwise(c)), "")
    cased = F.when(m == F.upper(m), F.upper(form)).otherwise(form)
    quote = F.when(kind == "secret", F.regexp_extract(F.substr(m, F.length(lead) + 1), r"[\"']$", 0)).otherwise("")
    return F.when(kind == "number", m).when(kind.isin(*_DIGITS), digits).when(kind.isin("email", "ip6"), cased).otherwise(
        F.concat(lead, form, quote))


def _mentions(text: Column) -> Column:
    """Entities of a text in order, as structs (m, kind, lead, canon)."""
    # a step for each part, so that each is written once in the plan and computed once per mention
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    found = F.transform(found, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    found = F.transform(found, lambda e: F.struct(e["m"].alias("m"), e["kind"].alias("kind"),
                                                  _lead(e["m"], e["kind"]).alias("lead")))
    return F.transform(found, lambda e: F.struct(
        e["m"].alias("m"), e["kind"].alias("kind"), e["lead"].alias("lead"),
        _canonical(e["m"], e["kind"], e["lead"]).alias("canon")))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, form): the surrogate of every distinct entity."""
    first = F.lit(0)
    open_ = kept(entities.select("kind", "canon").distinct().withColumn("attempt", first).withColumn(
        "form", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "entities")
    plain = F.when(F.col("kind") == "name", F.substr("canon", F.lit(3))).otherwise(F.col("canon"))
    real = open_.select("kind", plain.alias("form")).distinct().withColumn("real", F.lit(True))
    done = None
    for _ in range(MAX_ROUNDS):
        least = open_.groupBy("kind", "form").agg(F.min("canon").alias("winner"))
        tried = open_.join(least, ["kind", "form"]).join(real, ["kind", "form"], "left")
        clash = F.col("real").isNotNull() | (F.col("winner") != F.col("canon"))
        if done is not None:
            taken = done.select("kind", "form").withColumn("taken", F.lit(True))
            tried = tried.join(taken, ["kind", "form"], "left")
            clash = clash | F.col("taken").isNotNull()
        tried = kept(tried.select("kind", "canon", "attempt", "form", clash.alias("clash")), "attempts")
        good = tried.where("NOT clash").drop("clash")
        done = good if done is None else done.unionByName(good)
        open_ = tried.where("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return done
        open_ = kept(open_.withColumn("form", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "retry")
    raise RuntimeError(f"some entities still collide after {MAX_ROUNDS} attempts")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, and ``n_entities`` (int).

    Equal entities (same type and canonical form) get equal surrogates in all
    documents, different ones get different surrogates, and no surrogate is an
    entity that occurs. Texts without entities, and null texts (0 entities), stay
    as they are. All columns and repeated rows stay; a column named
    ``n_entities`` is replaced. Ids are not used, so null ids do no harm. An empty
    table gives no rows. The same key gives the same surrogates for the same
    table; another key gives others.
    """
    rows = docs.drop("n_entities")
    text = F.col(text_col)
    has = F.coalesce(text.rlike(_HINT), F.lit(False))
    none = F.expr("cast(array() as array<struct<m:string,kind:string,lead:string,canon:string>>)")
    rows = rows.withColumn("_e", F.when(has, _mentions(text)).otherwise(none))
    found = docs.select(F.explode(F.when(has, _mentions(text)).otherwise(none)).alias("e")).select("e.kind", "e.canon")
    found = found.where(F.col("kind") != "number")
    later = kept(assign(found, key).where("attempt > 0"), "later")
    if later.isEmpty():
        rows = rows.withColumn("_later", F.expr("cast(map() as map<string,string>)"))
    else:
        marked = rows.withColumn("_row", F.xxhash64(text))
        hit = marked.select("_row", F.explode("_e").alias("e")).select("_row", "e.kind", "e.canon").distinct().join(
            later, ["kind", "canon"])
        maps = hit.groupBy("_row").agg(F.map_from_entries(F.collect_set(
            F.struct(F.concat_ws("|", "kind", "canon"), F.col("form")))).alias("_later"))
        rows = marked.join(maps, "_row", "left").drop("_row")

    def new(e):
        form = F.coalesce(F.get(F.map_values(F.map_filter("_later", lambda k, _: k == F.concat_ws("|", e["kind"], e["canon"]))), F.lit(0)),
                          surrogate(e["kind"], e["canon"], F.lit(0), key))
        return _let(form, lambda f: _render(e["m"], e["kind"], e["lead"], f))

    parts = F.split(text, ENTITY, -1)
    made = F.array_join(F.zip_with(parts, F.transform("_e", new), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    return rows.withColumn(text_col, F.when(F.size("_e") > 0, made).otherwise(text)).withColumn(
        "n_entities", F.size(F.filter("_e", lambda e: e["kind"] != "number"))).select(*[c for c in docs.columns if c != "n_entities"], "n_entities")
