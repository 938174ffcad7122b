"""Personal data in texts, and the terms that give it away.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers, found by fixed patterns. Words
that go with an entity can reveal it although they are no personal data themselves. How strongly a term t reveals an entity e
is their pointwise mutual information over the corpus, log2(n(t, e) N / (n(t) n(e))), where n counts documents by their
whole texts, wherever in them t and e stand; words that are part of an entity are no terms. It is held against the
entity's own information content log2(N / n(e)), which it reaches when t never occurs without e. A term whose share is
`remove` or more is removed, one of `generalise` or more is replaced by what kind of word it is, at every place of every
text that holds e. Chance is kept out by asking that the two meet in at least two different texts.

The corpus is read twice: for the entities, and to count the documents of every term. The texts that hold entities are
kept, and their pairs of entity and term counted, but for those that cannot disclose: an entity must be in two different
texts, and a term with n(t) > n(e)^g N^(1-g), g being `generalise`, misses the share even if it is in all texts of e. Bloom
filters of bounded size sort these out in the tasks and the counts decide. Counts combine on the map side; a term or entity
that a third of all documents hold is a row of a join, which Spark splits.

Null and empty texts hold nothing. Repeated rows count each, but as one text. Columns that are not carried are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import OUT_ROWS, Bloom, bloom_of, known_words, map_batches, settle, words_of
from tallyloom.session import ship_package

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_MAIL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each @ is looked at once, so a text without matches costs no more than its length."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _MAIL and text[start - 1] != "@":
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        free = at + 1
        if start < at and domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four numbers with single dots between, taken from the left; those with a part over 255 are dropped."""
    out = []
    for run in _NUMBERS.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, row = run.start(), []
        for part in run.group().split("."):
            row = [*row, (part, at)] if part else []
            at += len(part) + 1
            if len(row) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p, _ in row):
                    out.append((row[0][1], at - 1))
                row = []
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def entities(text: str) -> list[tuple[str, int, int]]:
    found = {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}
    return [(k, i, j) for k in KINDS for i, j in found[k]]


def _entity_key(kind: str, value: str) -> int:
    """One key for different spellings of a value."""
    plain = value.lower() if kind in ("email", "ip") else "".join(c for c in value if c.isdigit())
    return xxhash.xxh64_intdigest(f"{kind}:{plain}".encode()) - (1 << 63)


def _terms(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """Words of the whole text that overlap no span, with their places."""
    spans, at, stop = sorted(spans), 0, 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            stop = max(stop, spans[at][1])
            at += 1
        if a >= stop:
            yield words_of(m.group().encode())[0], a, b


def with_entities(docs: DataFrame, carry: tuple[str, ...], row: str | None = None) -> DataFrame:
    """(row, doc_id, spans, entities, text_key, held) and the carried columns; held is the text of rows with entities."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate((*carry, *([row] if row else [])))])

    carried = "text" in carry  # then it need not come back twice

    def run(batch):
        spans, keys, numbers, held = [], [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            found = entities(text)
            spans.append([{"kind": k, "start": i, "stop": j} for k, i, j in found])
            numbers.append(sorted({_entity_key(k, text[i:j]) for k, i, j in found}))
            keys.append(xxhash.xxh64_intdigest(text.encode()) - (1 << 63) if found else 0)
            held.append(text if found and not carried else None)
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array(spans, pa.list_(span)),
                pa.array(numbers, pa.list_(pa.int64())),
                pa.array(keys, pa.int64()),
                pa.array(held, pa.string()),
                *batch.columns[2:],
            ],
            ["doc_id", "spans", "entities", "text_key", "held", *batch.schema.names[2:]],
        )

    schema = "doc_id long, spans array<struct<kind:string,start:long,stop:long>>, entities array<long>, text_key long, held string"
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[2:])
    out = map_batches(kept, run, schema)
    if carried:
        out = out.withColumn("held", F.when(F.size("entities") > 0, F.col(f"_c{carry.index('text')}")))
    own = ("doc_id", "spans", "entities", "text_key", "held")
    number = F.col(f"_c{len(carry)}").cast("long") if row else F.monotonically_increasing_id()
    return out.select(number.alias("row"), *own, *[F.col(f"_c{i}").alias(f"_kept_{c}") for i, c in enumerate(carry)])


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_term): documents that hold each term outside of entities."""

    def counted(counts):
        keys = np.fromiter(counts, np.uint64, len(counts)) ^ np.uint64(1 << 63)
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    def run(batches):
        hashes, counts = known_words(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                found = entities(text)
                words = {w for w, _, _ in _terms(text, [x[1:] for x in found])} if found else set(words_of(text.encode()))
                counts.update(map(hashes.__getitem__, words))
                if len(counts) > OUT_ROWS:
                    yield counted(counts)
                    counts.clear()
        yield counted(counts)

    ship_package(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _met(base: DataFrame, of_entity: Bloom, of_term: Bloom, of_pair: Bloom | None = None) -> DataFrame:
    """(row, text_key, entity, term): distinct pairs of a row's entities and its terms that pass the filters."""

    def run(batch):
        hashes = known_words()
        row_of, key_of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, key, text, spans, own in zip(row_of, key_of, *[batch.column(i).to_pylist() for i in (2, 3, 4)]):
            own = np.array(own, np.int64)
            own = own[of_entity.hits(own.view(np.uint64))]
            if not len(own):
                continue
            words = {w for w, _, _ in _terms(text, [(x["start"], x["stop"]) for x in spans])}
            terms = (np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)
            terms = terms[of_term.hits(terms.view(np.uint64))]
            for entity in own:
                some = terms if of_pair is None else terms[of_pair.hits((terms ^ entity).view(np.uint64))]
                if len(some):
                    fixed = [pa.array(np.full(len(some), x, np.int64)) for x in (row, key, entity)]
                    yield pa.record_batch([*fixed, pa.array(some)], ["row", "text_key", "entity", "term"])

    def joined(batch):
        """Few large batches instead of one for each entity of a row."""
        waiting, n = [], 0
        for part in run(batch):
            waiting.append(part)
            n += part.num_rows
            if n >= OUT_ROWS:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, n = [], 0
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    held = base.where("size(entities) > 0").select("row", "text_key", "held", "spans", "entities")
    return map_batches(held, joined, "row long, text_key long, entity long, term long")


def _marked(rows: DataFrame) -> DataFrame:
    """(row, terms) of (row, held, spans, marks): every place at which a marked term stands."""
    place = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("action", pa.string())])

    def run(batch):
        hashes, out = known_words(), []
        for text, spans, marks in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
            action = {x["term"]: x["action"] for x in marks}
            found = ((hashes[w] - (1 << 63), a, b) for w, a, b in _terms(text, [(x["start"], x["stop"]) for x in spans]))
            out.append([{"start": a, "stop": b, "action": action[t]} for t, a, b in found if t in action])
        yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(place))], ["row", "terms"])

    return map_batches(rows.select("row", "held", "spans", "marks"), run, "row long, terms array<struct<start:long,stop:long,action:string>>")


def disclosures(
    docs: DataFrame, generalise: float = 0.8, remove: float = 0.95, carry: tuple[str, ...] = (), row: str | None = None
) -> DataFrame:
    """(row, doc_id, spans, terms) and the carried columns of every row.

    `spans` are the entities as (kind, start, stop) in code points; `terms` are (start, stop, action) of all places of
    the terms that disclose one of them, action being remove or generalise. `row` is passed on from the column so named,
    which must be unique, else it is a number. A caller with a row number needs to carry nothing: it can join what it wants
    to the few rows with entities.
    """
    base = settle(with_entities(docs, carry, row), "pii-entities")
    n = max(base.count(), 1)
    mentions = base.select("text_key", F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"), (F.min("text_key") != F.max("text_key")).alias("apart")
    )
    # An entity of all documents tells nothing that could be disclosed; one of a single text meets no term in two.
    shared = settle(mentions.where(f"apart and n_entity < {n}").drop("apart"), "pii-shared")
    most = shared.agg(F.max("n_entity")).first()[0] or 0
    bound = most * (n / max(most, 1)) ** (1 - min(generalise, 1)) * (1 + 1e-9)
    counted = settle(term_counts(docs).where(f"n_term between 2 and {bound}"), "pii-terms")
    of_entity, of_term = bloom_of(shared, "entity"), bloom_of(counted, "term")
    together = _met(base, of_entity, of_term).groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_both"), (F.min("text_key") != F.max("text_key")).alias("apart")
    )
    judged = (
        together.where("apart")
        .join(shared, "entity")
        .join(counted, "term")
        .withColumn("content", F.log2(F.lit(float(n)) / F.col("n_entity")))
        .withColumn("shown", F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_term").cast("double") * F.col("n_entity"))))
        .where(f"shown >= {generalise} * content")
    )
    action = F.when(F.col("shown") >= remove * F.col("content"), "remove").otherwise("generalise")
    told = settle(judged.select("entity", "term", action.alias("action")), "pii-told")

    of_pair = bloom_of(told.select(F.col("entity").bitwiseXOR(F.col("term")).alias("pair")), "pair")
    marks = (
        _met(base, of_entity, of_term, of_pair)
        .join(told, ["entity", "term"])
        .groupBy("row", "term")
        .agg(F.max("action").alias("action"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("term", "action")).alias("marks"))
    )
    # A row holds terms of its own text only; what is broadcast stays within some megabytes.
    terms = settle(_marked(base.select("row", "held", "spans").join(marks, "row")), "pii-marked")
    if (terms.agg(F.sum(F.size("terms"))).first()[0] or 0) <= 200_000:
        terms = F.broadcast(terms)
    out = base.drop("entities", "text_key", "held").join(terms, "row", "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint,action:string>>")
    return out.select(
        "row", "doc_id", "spans", F.coalesce("terms", none).alias("terms"), *[F.col(f"_kept_{c}").alias(c) for c in carry]
    )


def listed(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): spans as kind:start:end, comma-joined, terms last."""
    name = "concat_ws(':', {kind}, cast(x.start as string), cast(x.stop as string))"
    base = F.expr(f"transform(spans, x -> {name.format(kind='x.kind')})")
    terms = F.expr(f"transform(terms, x -> {name.format(kind=repr(TERM))})")
    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def sanitised(found: DataFrame) -> DataFrame:
    """`found`, which must carry `text`, with entities and disclosing terms taken out of it."""
    columns = found.columns
    schema = found.schema["text"].dataType.simpleString()

    def run(batch):
        texts = []
        for text, spans, terms in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            cuts = [(x["start"], x["stop"], f"<{x['kind'].upper()}>") for x in spans or []]
            for x in terms or []:
                word = (text or "")[x["start"] : x["stop"]]
                kind = "<NUMBER>" if word.isdigit() else "<NAME>" if word[:1].isupper() else "<WORD>"
                cuts.append((x["start"], x["stop"], "" if x["action"] == "remove" else kind))
            texts.append(replaced(text, cuts))
        yield pa.record_batch([pa.array(texts, pa.string()), *batch.columns[3:]], ["text", *batch.schema.names[3:]])

    rest = [c for c in columns if c not in ("text", "spans", "terms")]
    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in rest)
    return map_batches(found.select("text", "spans", "terms", *rest), run, f"text {schema}, {kinds}")


def replaced(text: str | None, cuts: list[tuple[int, int, str]]) -> str | None:
    """The text with each cut replaced; overlapping cuts are one, named by the first."""
    if not cuts:
        return text
    out, at = [], 0
    for start, stop, name in sorted(cuts):
        if start >= at:
            out += [text[at:start], name]
        at = max(at, stop)
    return "".join([*out, text[at:]])

