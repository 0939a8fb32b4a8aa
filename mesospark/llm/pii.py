"""PII surrogates: keyed, type-consistent replacements of detected entities.

Digits, letters and hex digits of an entity are replaced by a keyed Feistel
network over positions of the same kind, so equal entities get equal replacements
anywhere (coreference), and distinct entities of one kind distinct ones, as the network is a
permutation. What counts is the entity, not how it is written: telephone and card
numbers are their digits (North American ones with or without the country's 1),
mail addresses their lower case; IPv6 addresses count as they are spelt. A replacement is
written as the entity was. Valid card numbers, account numbers and addresses stay valid, and
others stay invalid.

Names are replaced by names of the same gender and script from keyed lists. As
such lists are short, names that meet in one choice are numbered over the whole
corpus, and all but the first get further syllables that tell their number; no
two names of a corpus share a replacement, whatever the title before them. A
titled last word of one full name of the text is that name. A name's gender is what its titles say anywhere in the corpus. Documents without
a titled name take no part in this.

Defined cases: null and empty texts pass through with no entities; repeated
rows and null ids are treated like any other; kept columns pass through, and
none of them may be named ``n_entities``.
"""

import hashlib
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesospark.plans.lineage import cut

#: Given names by script and gender, and titles that announce a name with its gender.
NAMES = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Frida", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nadia", "Olga", "Paula", "Rosa", "Sofia"],
    ("latin", "m"): ["Adam", "Boris", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Oskar", "Peter", "Simon"],
    ("latin", "n"): ["Alex", "Robin", "Kim", "Sasha", "Chris", "Dana", "Jamie", "Toni"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"],
    ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Максим", "Олег", "Павел", "Сергей", "Юрий"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя"],
}
TITLES = {"Mr": "m", "Herr": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Frau": "f", "Mme": "f", "Sra": "f", "Dr": "n", "Prof": "n", "г-н": "m", "г-жа": "f"}
SYLLABLES = {"latin": ["ber", "dan", "fel", "gor", "hal", "kin", "lor", "mer", "nor", "per", "ros", "sten", "tal", "vin", "wel", "zan"], "cyrillic": ["бер", "дан", "вол", "гор", "лев", "мар", "нов", "пет"]}
#: Formats of entities; the first alternative that matches at a place names the kind.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"
    r"|(?P<awskey>\bAKIA[A-Z0-9]{16}\b)"
    r"|(?P<secret>(?<=token = \")[0-9A-Za-z]{16,}(?=\"))"
    r"|(?=[aAbBpPsStT])(?<![A-Za-z0-9])(?:(?i:passw(?:or)?d|pwd)=[\"']?(?P<password>[^\s\"']{5,}[^\s\"'.,;:!?)\]}])"
    r"|(?i:(?:api|access|secret|private|auth)[_ -]?(?:access[_-]?)?(?:key|token)|client[_-]secret|secret|token|passw(?:or)?d|pwd)[\"']?\s{0,3}(?::|=)\s{0,3}[\"']?(?P<keyed>(?=[^\s\"']*\d)[^\s\"']{5,}[^\s\"'.,;:!?)\]}])"
    r"|(?i:bearer)\s(?P<bearer>(?=[A-Za-z0-9._~+/=-]*\d)[A-Za-z0-9._~+/-]{16,}=*))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)\+?\d{1,3} ?\(\d{2,4}\) ?\d{3}-\d{4}(?!\d)|(?<![\w+])\+\d(?:[ .()/-]{0,2}\d){7,14}(?!\d)"
    r"|(?<![\w.+-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])|(?<![\w.+-])(?:1 )?[2-9]\d\d [2-9]\d\d[ -]\d{4}(?![\w-])"
    r"|(?<![\w.,+-])(?:0\d{1,4}[ /-]\d{5,8}|\(0\d{1,4}\) ?\d{5,8}|0\d(?:[ .-]\d\d){4})(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7})(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{6,39}(?![\w:]))"
    r"|(?P<name>(?=[A-ZÀ-ÞА-Я])(?:(?<=\bMr )|(?<=\bMr\. )|(?<=\bMrs )|(?<=\bMrs\. )|(?<=\bMs )|(?<=\bMs\. )|(?<=\bDr )|(?<=\bDr\. )|(?<=\bProf\. )|(?<=\bHerr )|(?<=\bFrau )|(?<=\bMme )|(?<=\bSr\. )|(?<=\bSra\. )|(?<=г-н )|(?<=г-жа ))"
    r"[A-ZÀ-ÞА-Я][\w'’]*(?:-[A-ZÀ-ÞА-Я][\w'’]*)?(?: [A-ZÀ-ÞА-Я][\w'’]*(?:-[A-ZÀ-ÞА-Я][\w'’]*)?)?)"
)
#: Every entity holds an @ or a digit, or stands after one of these.
_SIGN = re.compile(r"[@\d]|(?i:passw|pwd)")
_MARKS = ("AKIA", "token = ", *(f"{t}{dot} " for t in ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr", "Sra", "г-н", "г-жа") for dot in ("", ".")))
_NAMES = "names of the text"
_TITLE = re.compile(r"(\S+?)\.? $")


def _digest(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def _radix(c: str, hexadecimal: bool) -> tuple[str, int] | None:
    if hexadecimal and c in "0123456789abcdef":
        return "0123456789abcdef", 16
    for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in alphabet:
            return alphabet, len(alphabet)
    return None


def permuted(key: bytes, kind: str, text: str, hexadecimal: bool = False) -> str:
    """A keyed permutation of the texts with the same kind of character in each place."""
    kinds = [_radix(c, hexadecimal) for c in text]
    at = [i for i, k in enumerate(kinds) if k]
    values = [kinds[i][0].index(text[i]) for i in at]
    shape = "".join(k[0][0] if k else c for k, c in zip(kinds, text, strict=True))
    half = len(at) // 2
    for turn in range(6):
        one, two = (range(half), range(half, len(at))) if turn % 2 else (range(half, len(at)), range(half))
        mask = _digest(key, kind, shape, turn, *(values[i] for i in two))
        for i in one:
            n = kinds[at[i]][1]
            mask, add = divmod(mask, n) if mask > n else (_digest(key, kind, shape, turn, i, *(values[j] for j in two)), 0)
            values[i] = (values[i] + add) % n
    out = list(text)
    for i, v in zip(at, values, strict=True):
        out[i] = kinds[i][0][v]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    """The two check digits of an account."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _is_iban(entity: str) -> bool:
    flat = entity.replace(" ", "")
    return 15 <= len(flat) <= 34 and flat[2:4] == _iban_check(flat[:2], flat[4:])


def _is_ipv6(entity: str) -> bool:
    try:
        return any(c.isdigit() for c in entity) and bool(ipaddress.IPv6Address(entity))
    except ValueError:
        return False


def script_of(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "latin"


def name_choice(key: bytes, entity: str, gender: str) -> tuple[str, str]:
    """The first choice for a name: a given name that is not its own (empty for a name of one word), and a family name of two syllables."""
    script = script_of(entity)
    given, parts, n = NAMES[script, gender if gender in "fm" else "n"], SYLLABLES[script], _digest(key, "name", entity)
    family = parts[n % len(parts)] + parts[n // len(parts) % len(parts)]
    n //= len(parts) ** 2
    if " " not in entity:
        return "", family.capitalize()
    chosen = given[n % len(given)]
    return given[(n + 1) % len(given)] if chosen == entity.split()[0] else chosen, family.capitalize()


def numbered_name(given: str, family: str, number: int) -> str:
    """The name of the given number (from 0) of those that meet in one choice: its digits as further syllables.

    No syllable begins another one, so the syllables of a family name can be told apart.
    """
    parts, more = SYLLABLES[script_of(family)], ""
    while number:
        number, digit = divmod(number, len(parts))
        more += parts[digit]
    return f"{given} {family}{more}".strip()


def _valid_ip(entity: str) -> bool:
    return all(str(int(x)) == x and int(x) < 256 for x in entity.split("."))


def _in_place(entity: str, digits: str) -> str:
    """The entity with other digits in the places of its own."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in entity)


def surrogate(key: bytes, kind: str, entity: str) -> str:
    """The replacement of an entity that is no name."""
    if kind == "email":
        local, _, domain = entity.lower().rpartition("@")
        labels = domain.split(".")
        host = ".".join([*(permuted(key, "domain", x) for x in labels[:-1]), labels[-1]])
        out = f"{permuted(key, kind + domain, local)}@{host}"
        return "".join(n.upper() if c.isupper() else n for n, c in zip(out, entity, strict=True))
    if kind == "phone":
        digits = re.sub("[^0-9]", "", entity)
        country = digits[:1] if len(digits) == 11 and re.match(r"\+?1", entity) else ""
        return _in_place(entity, country + permuted(key, kind, digits[len(country) :]))
    if kind == "ip":
        if not _valid_ip(entity):
            out = permuted(key, kind, entity)
            while _valid_ip(out):  # valid ones belong to valid addresses: walk on
                out = permuted(key, kind, out)
            return out
        octets = [int(x) for x in entity.split(".")]
        for turn in range(4):
            one, two = ((0, 1), (2, 3)) if turn % 2 else ((2, 3), (0, 1))
            mask = _digest(key, kind, turn, octets[two[0]], octets[two[1]])
            for i, o in enumerate(one):
                octets[o] = (octets[o] + (mask >> (8 * i))) % 256
        return ".".join(map(str, octets))
    if kind == "card":
        digits = re.sub("[^0-9]", "", entity)
        if _luhn(digits[:-1]) == int(digits[-1]):
            head = permuted(key, kind + "valid", digits[:-1])
            return _in_place(entity, head + str(_luhn(head)))
        out = permuted(key, kind, digits)
        while _luhn(out[:-1]) == int(out[-1]):  # valid ones belong to valid cards: walk on
            out = permuted(key, kind, out)
        return _in_place(entity, out)
    if kind == "iban":
        rest = permuted(key, kind + entity[:2], entity[4:])
        return entity[:2] + _iban_check(entity[:2], rest.replace(" ", "")) + rest
    if kind == "ipv6":
        out = permuted(key, kind, entity.lower(), hexadecimal=True)
        return out.upper() if entity == entity.upper() else out
    if kind == "awskey":
        return entity[:4] + permuted(key, kind, entity[4:])
    return permuted(key, kind, entity, hexadecimal=kind == "secret" and bool(re.fullmatch("[0-9a-f]+", entity)))


def _owners(names) -> dict[str, str]:
    """The full name of each name of one word that is the last word of that one alone."""
    whole: dict[str, set] = {}
    for n in names:
        if " " in n:
            whole.setdefault(n.rpartition(" ")[2], set()).add(n)
    return {n: next(iter(whole[n])) for n in names if len(whole.get(n, ())) == 1}


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and text of each entity, in order. Further mentions of a titled name count too;
    one by the last word alone is of kind ``last`` and has the whole name as its text."""
    out: list = []
    names: dict[str, None] = {}
    if not text or not (_SIGN.search(text) or any(m in text for m in _MARKS)):
        return out
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        start, end, entity = m.start(kind), m.end(kind), m[kind]
        if kind == "iban" and not _is_iban(entity) or kind == "ipv6" and not _is_ipv6(entity):
            continue
        if kind in ("password", "keyed", "bearer"):
            kind = "secret"
        if kind == "name":
            names[entity] = None
        out.append((start, end, kind, entity))
    owners = _owners(names)
    if owners:
        out = [(a, b, "last", owners[e]) if kind == "name" and e in owners else (a, b, kind, e) for a, b, kind, e in out]
    return _with_mentions(text, out, [n for n in names if n not in owners]) if names else out


def genders(text: str | None) -> dict[str, str]:
    """The titled names of a text with what their titles say: f, m, n (nothing) or x (both)."""
    names: dict[str, str] = {}
    for m in PATTERN.finditer(text or ""):
        if m.lastgroup == "name":
            title = _TITLE.search(text[max(0, m.start("name") - 8) : m.start("name")])
            gender, before = TITLES.get(title[1] if title else "", "n"), names.get(m["name"], "n")
            names[m["name"]] = _agreed(gender, before)
    for word, whole in _owners(names).items():
        names[whole] = _agreed(names.pop(word), names[whole])
    return names


def _agreed(gender: str, before: str) -> str:
    return gender if before in ("n", gender) else before if gender == "n" else "x"


def _with_mentions(text: str, out: list, names) -> list:
    mentions = {n: ("name", n) for n in names}
    last: dict[str, set] = {}
    for n in names:
        if " " in n:
            last.setdefault(n.rpartition(" ")[2], set()).add(n)
    for word, whole in last.items():  # a last word that several names have says nothing
        if word not in mentions and len(whole) == 1:
            n = next(iter(whole))
            mentions[word] = ("last", n)
    taken, more, i = sorted((a, b) for a, b, *_ in out), [], 0
    found = re.compile(r"(?<![\w'’@.-])(?:" + "|".join(map(re.escape, sorted(mentions, key=lambda n: (-len(n), n)))) + r")(?![\w@-])")
    for m in found.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or m.end() <= taken[i][0]:
            more.append((m.start(), m.end(), *mentions[m[0]]))
    return sorted(out + more)


#: A text with a title, for the reader of Spark's expressions; a first sieve, as PATTERN decides.
_TITLED = r"(?:^|[^\p{L}\p{N}_])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|г-н|г-жа)\.? [A-ZÀ-ÞА-Я]"


def _text_key(text: str) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def named_texts(documents: DataFrame) -> DataFrame:
    """``key, entity, gender``: the titled names of each distinct text that has any."""

    def run(batches):
        for batch in batches:
            found = [genders(t) for t in batch.column("text").to_pylist()]
            lists = [pa.array([list(d) for d in found], pa.list_(pa.string())), pa.array([list(d.values()) for d in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *lists], names=["a", "b", "names", "genders"])

    texts = documents.filter(F.col("text").rlike(_TITLED)).select(_text_key("text").alias("key"), "text").select("key.a", "key.b", "text")
    found = texts.mapInArrow(run, "a long, b long, names array<string>, genders array<string>")
    return found.select(F.struct("a", "b").alias("key"), F.explode(F.arrays_zip("names", "genders")).alias("x")).select("key", F.col("x.names").alias("entity"), F.col("x.genders").alias("gender")).distinct()


def name_table(named: DataFrame, key: bytes) -> DataFrame:
    """``entity, new``: the names of the corpus and their replacements, all distinct.

    Names that meet in one choice are numbered in order; choices are spread by a
    keyed hash over more groups than any list has names, so groups stay even.
    """
    says = F.collect_set(F.when(F.col("gender") != "n", F.col("gender")))
    names = named.groupBy("entity").agg(F.when(F.size(says) == 1, says[0]).otherwise(F.lit("n")).alias("gender"))

    def choose(batches):
        for batch in batches:
            made = [name_choice(key, e, g) for e, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g for g, _ in made], pa.string()), pa.array([f for _, f in made], pa.string())], names=["entity", "given", "family"])

    def number(batches):
        for batch in batches:
            made = [numbered_name(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("given", "family", "number")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("entity"), pa.array(made, pa.string())], names=["entity", "new"])

    chosen = names.mapInArrow(choose, "entity string, given string, family string")
    nth = (F.row_number().over(Window.partitionBy("given", "family").orderBy("entity")) - 1).alias("number")
    return chosen.select("entity", "given", "family", nth).mapInArrow(number, "entity string, new string")


def replaced(text: str | None, key: bytes, names: dict[str, str], memo: dict) -> tuple[str | None, int]:
    """The text with its entities replaced, and how many; ``names`` gives the replacements of its titled names."""
    found = entities(text)
    if not found:
        return text, 0
    out, last = [], 0
    for a, b, kind, entity in found:
        if kind in ("name", "last"):
            new = names[entity]
            new = new.rpartition(" ")[2] if kind == "last" else new
        else:
            if (kind, entity) not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[kind, entity] = surrogate(key, kind, entity)
            new = memo[kind, entity]
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), len(found)


def pseudonymise(documents: DataFrame, key: bytes, *, keep=("doc_id", "text"), broadcast_limit: int = 1 << 16) -> DataFrame:
    """The kept columns with entities in text replaced, and ``n_entities long``."""
    if "n_entities" in keep:
        raise ValueError("rename n_entities before it is kept")
    named = cut(named_texts(documents))
    pairs = F.map_from_entries(F.collect_list(F.struct("entity", "new")))
    per = cut(named.join(name_table(named, key), "entity").groupBy("key").agg(pairs.alias("names")))
    n = per.count()  # texts with a titled name
    source = documents.select(*keep).alias("d")
    if n:
        met = F.broadcast(per) if n <= broadcast_limit else per
        source = source.join(met.alias("p"), _text_key("d.text") == F.col("p.key"), "left").select("d.*", F.col("p.names").alias(_NAMES))
    types = [f"`{c}` {t}" for c, t in source.dtypes if c != _NAMES]

    def run(batches):
        memo: dict = {}
        for batch in batches:
            names = batch.column(_NAMES).to_pylist() if n else [None] * batch.num_rows
            done = [replaced(t, key, dict(m or ()), memo) for t, m in zip(batch.column("text").to_pylist(), names, strict=True)]
            columns = [pa.array([t for t, _ in done], pa.string()) if c == "text" else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], names=[*keep, "n_entities"])

    return source.mapInArrow(run, ", ".join([*types, "n_entities long"]))
