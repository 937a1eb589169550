"""Replace personal data by surrogates of the same type and shape.

Each detected entity gets a keyed surrogate: digits for digits, letters for letters of the same script
and case, valid addresses for addresses, given names for given names of the same gender and script.  One
entity has one surrogate in the whole corpus, however it is written, digits of any script included.  Surrogates
that two entities share, or that are themselves entities of the corpus, are drawn again until all are
distinct; only the losers of a round go on, and after some rounds theirs grow by one character a round, so
a shape that has fewer surrogates than entities ends too.  Texts without a possible entity are not moved."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balsam.llm.common import discard, settle

#: Given names by gender and script.
GIVEN_NAMES = {
    ("female", "latin"): "Alice Anna Barbara Carla Charlotte Claudia Elena Emma Greta Hanna Helen Ingrid Isabel Julia Laura Lucia Maria Marta Monika Nadia Olivia Paula Sabine Sofia Susan".split(),
    ("male", "latin"): "Alan Albert Bernd Carlos Daniel David Diego Emil Franz George Hans Henry Ivan James John Karl Luis Marco Michael Pablo Peter Robert Stefan Thomas Victor".split(),
    ("female", "cyrillic"): "Анна Вера Галина Елена Ирина Мария Надежда Ольга Светлана Татьяна".split(),
    ("male", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("female", "greek"): "Αγγελική Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("male", "greek"): "Αλέξανδρος Γιώργος Δημήτρης Ιωάννης Κώστας Μιχάλης Νίκος Παύλος".split(),
}
_NAME_KIND = {name: f"given:{gender}:{script}" for (gender, script), names in GIVEN_NAMES.items() for name in names}
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_SURNAME = r"[A-ZÀ-ÞА-ЯΑ-Ω][a-zß-ÿа-яά-ώ]{2,}(?:-[A-ZÀ-ÞА-ЯΑ-Ω][a-zß-ÿа-яά-ώ]+)?"
#: Titles that a person's name follows.
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sra"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_PATTERN = re.compile("|".join([
    r"(?P<email>[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})",
    r"(?P<secret>\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}\b)",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
    rf"(?P<address>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))",
    r"(?P<national>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))",
    r"(?P<phone>(?<![\d.])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\d))",
    r"(?P<intl>(?<![\d.])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d))",
    rf"(?:\b(?:{_TITLES})\.? (?P<first>{_SURNAME}(?= {_SURNAME}))?(?: )?(?P<titled>{_SURNAME}))",
    rf"(?:\b(?P<given>{'|'.join(sorted(_NAME_KIND, key=lambda n: (-len(n), n)))}) (?P<surname>{_SURNAME}))",
]))
#: What a text with an entity holds at least; wider than the patterns, and names are tried at capitals only.
MAYBE = rf"[@\p{{Nd}}]|\b(?:{_TITLES})\.? |(?=[" + "".join(sorted({name[0] for name in _NAME_KIND})) + "])(?:" + "|".join(sorted(_NAME_KIND)) + ")"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order."""
    out = []
    for m in _PATTERN.finditer(text):
        if m["titled"]:
            if m["first"]:
                kind = _NAME_KIND.get(m["first"])
                out.append((*m.span("first"), kind or "surname", m["first"] if kind else m["first"].lower()))
            out.append((*m.span("titled"), "surname", m["titled"].lower()))
        elif m["given"]:
            out.append((*m.span("given"), _NAME_KIND[m["given"]], m["given"]))
            out.append((*m.span("surname"), "surname", m["surname"].lower()))
        else:
            out.append((*m.span(), *_canonical(m.lastgroup, m[0])))
    names = {text[a:b] for a, b, kind, _ in out if kind == "surname"}
    if names:  # a surname that stands alone later means the same person
        taken = {a for a, *_ in out}
        alone = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n)))) + r")\b")
        out += [(*m.span(), "surname", m[0].lower()) for m in alone.finditer(text) if not any(a <= m.start() < b for a, b, *_ in out) and m.start() not in taken]
        out.sort()
    return out


def _canonical(kind: str, found: str) -> tuple[str, str]:
    if kind in ("email", "secret", "address"):
        return kind, found.lower()
    plain = re.sub(r"[^0-9A-Za-z]", "", "".join(str(unicodedata.digit(c)) if c.isdecimal() else c for c in found))
    if kind in ("phone", "intl"):  # the last ten digits: with or without a country code
        return "phone", plain[-10:]
    return kind, plain


class _Stream:
    """Numbers that only the key, the entity and the attempt decide."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.name, self.n, self.left = key, "\0".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.blake2b(self.name + self.n.to_bytes(4, "little"), key=self.key).digest()
            self.n += 1
        x, self.left = int.from_bytes(self.left[:4], "little"), self.left[4:]
        return x % n


def _letter(c: str, s: _Stream) -> str:
    if c.isdigit():
        return str(s.below(10))
    for alphabet in _ALPHABETS:
        if c.lower() in alphabet:
            new = alphabet[s.below(len(alphabet))]
            return new.upper() if c.isupper() else new
    if c.isalpha():
        alphabet = _ALPHABETS[0]
        for other, low, high in ((1, 0x400, 0x52F), (2, 0x370, 0x3FF)):
            alphabet = _ALPHABETS[other] if low <= ord(c) <= high else alphabet
        new = alphabet[s.below(len(alphabet))]
        return new.upper() if c.isupper() else new
    return c


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


#: Rounds in which a surrogate keeps the length of its entity; each later one adds a character.
SAME_LENGTH = 8


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Canonical surrogate of a canonical entity."""
    grown = max(0, attempt + 1 - SAME_LENGTH)
    if grown and kind == "address":
        s = _Stream(key, kind, value, attempt)  # beyond the four numbers: the longer form of such addresses
        return "2001:db8:" + ":".join(f"{s.below(1 << 16):x}" for _ in range(6))
    if grown and not kind.startswith("given"):
        value = ("x" * grown if kind == "email" else "") + value + ("" if kind == "email" else ("a" if value[-1:].isalpha() else "0") * grown)
    s = _Stream(key, kind.partition(":")[0] if not kind.startswith("given") else kind, value, attempt)
    if kind.startswith("given"):
        _, gender, script = kind.split(":")
        names = GIVEN_NAMES[gender, script]
        # A keyed order of the list, each name to the next: no two names meet, none stays.
        order = sorted(names, key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
        return order[(order.index(value) + 1 + attempt) % len(order)]
    if kind == "address":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "secret":
        return "".join("0123456789abcdef"[s.below(16)] for _ in value)
    if kind == "email":
        name, _, end = value.rpartition(".")
        return "".join(_letter(c, s) for c in name) + "." + end
    if kind == "iban":
        return value[:2] + "".join(_letter(c, s) for c in value[2:])
    if kind == "phone":
        return str(2 + s.below(8)) + "".join(str(s.below(10)) for _ in value[1:])
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        return body + (next(d for d in "0123456789" if luhn(body + d)) if luhn(value) else str(s.below(10)))
    return "".join(_letter(c, s) for c in value)


def render(kind: str, found: str, new: str) -> str:
    """A surrogate in the shape of the text it replaces: its separators, prefix and letter case."""
    if kind in ("address", "secret") or kind.startswith("given"):
        return new
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(found, new, strict=True)) if len(found) == len(new) else new
    if kind == "surname":
        head = "".join(n.upper() if c.isupper() else n for c, n in zip(found, new, strict=False))
        return head + new[len(head) :]
    fill, at, rest = list(found), len(found) - 1, list(new)
    while rest and at >= 0:
        if fill[at].isalnum():
            c = rest.pop()
            # A digit stays in its script.
            fill[at] = chr(ord(fill[at]) - unicodedata.digit(fill[at]) + int(c)) if fill[at].isdecimal() and c.isdigit() else c
        at -= 1
    first = next((i for i, c in enumerate(fill) if c.isalnum()), len(fill))
    return "".join(fill[:first] + rest + fill[first:])


def _mentions(rows: DataFrame) -> DataFrame:
    """(row, kind, value): the distinct entities of each row (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                found = {(kind, value) for *_, kind, value in entities(text.as_py() or "")}
                out += [(row.as_py(), kind, value) for kind, value in sorted(found)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["row", "kind", "value"])

    return rows.select("row", "text").mapInArrow(run, "row string, kind string, value string")


def assign_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): all surrogates of a kind differ, and none is a value of it.

    Given names keep to their list.  All else ends: each round after SAME_LENGTH has several times as many surrogates."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())],
                                             ["kind", "value", "attempt", "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    names = F.col("kind").startswith("given")
    done = settle(found.where(names).withColumn("attempt", F.lit(0)).select("kind", "value", "attempt").mapInArrow(draw, schema))
    real = settle(found.where(~names))
    left = real.withColumn("attempt", F.lit(0))
    taken = real.select("kind", F.col("value").alias("surrogate"))
    while True:
        drawn = settle(left.select("kind", "value", "attempt").mapInArrow(draw, schema))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        won = first.join(taken, ["kind", "surrogate"], "left_anti")
        won = settle(drawn.join(won, ["kind", "surrogate", "value"], "left_semi").select("kind", "value", "attempt", "surrogate"))
        done = done.unionByName(won)
        taken = taken.union(won.select("kind", "surrogate"))
        left = drawn.join(won.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        if left.isEmpty():
            return done.select("kind", "value", "surrogate")


def replace_pii(docs: DataFrame, key: bytes = b"surrogates", text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions), kinds (sorted, distinct) for every row of `docs`.

    Null texts stay null; null and repeated doc_ids are rows as any other; equal texts get equal
    surrogates.  Other columns are ignored; an empty table gives no rows."""
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Equal texts are rewritten alike, so the text's digest names the row.
    rows = settle(base.where(maybe).withColumn("row", F.sha2("text", 256)))
    mentions = settle(_mentions(rows).distinct())
    given = assign_surrogates(mentions.select("kind", "value").distinct(), key)
    pairs = mentions.join(given, ["kind", "value"]).groupBy("row").agg(
        F.collect_list(F.struct("kind", "value", "surrogate")).alias("pairs"))
    pairs = settle(pairs)
    discard(mentions)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for t, pairs in zip(batch.column(1), batch.column(2), strict=True):
                t, new = t.as_py(), {(p["kind"], p["value"]): p["surrogate"] for p in pairs.as_py() or []}
                found = entities(t) if new else []
                out, done = [], 0
                for a, b, kind, value in found:
                    out += [t[done:a], render(kind, t[a:b], new[kind, value])]
                    done = b
                texts.append("".join(out) + t[done:])
                counts.append(len(found))
                kinds.append(sorted({f[2] for f in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                                              pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "text", "n_entities", "kinds"])

    kind = base.schema["doc_id"].dataType.simpleString()
    touched = rows.join(pairs, "row", "left").select("doc_id", "text", "pairs").mapInArrow(
        rewrite, f"doc_id {kind}, text string, n_entities bigint, kinds array<string>")
    plain = base.where(~maybe).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return touched.union(plain)
