"""License statements in texts: an exact set-similarity join of text windows with statement templates.

Windows are runs of consecutive words over the whole text, whatever its line breaks, as sets of words. A template of n words
is found in a text if one of its windows of n / `share` words holds at least `share` of the template's distinct words.
Words are ordered by how many texts hold them, rarest first, counted over the whole corpus. A window that holds enough of
a template must hold one of its first len - need + 1 words (prefix filter), so only windows around these words are looked
at. Each is looked at from the rarest word that it shares with the template: only words that come no earlier in the order
can add to the overlap, and the words on both sides must hold enough of these (positional filter), within the
template's width (length filter), before windows are compared one by one. So no window is missed and none is wrongly found. Overlapping windows that hold a template are one match.

The templates are a fixed list, so their words, the word order and the templates' rows are bounded and small. Texts
are read twice (order, then join) and never shuffled; only the few words around a prefix word leave their row.
All of it is built-in expressions.

Null and empty texts have no words. Repeated rows are answered each. Other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import settle

BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{BREAKS}]+"

#: Phrases that carry a label by themselves.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Statements by which a text names its license, one sentence each.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0-1.0": "dedicated to the public domain under cc0 1 0 universal",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
}


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def token_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words by the number of texts that hold them, rarest first."""
    known = sorted({w for t in templates.values() for w in t.split()})
    held = F.array_intersect(F.array(*map(F.lit, known)), F.split(F.lower("text"), f"[{BREAKS}]+"))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.word: r.n for r in counted.collect()}  # one row for each word of the fixed templates
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def prefixes(templates: dict[str, str], order: list[str], share: float) -> list[tuple]:
    """(label, word, width, size, need, words from this one on in the order) for the prefix words of each template."""
    out = []
    for label, text in templates.items():
        own = sorted(set(text.split()), key=order.index)
        need = math.ceil(round(share * len(own), 9))
        width = math.floor(round(len(text.split()) / share, 9))
        out += [(label, w, width, len(own), need, own[i:]) for i, w in enumerate(own[: len(own) - need + 1])]
    return out


def _prefix_table(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    quote = lambda w: "'" + w + "'"  # noqa: E731  words are ASCII letters and digits
    values = ", ".join(
        f"({quote(a)}, {quote(w)}, {width}, {n}, {need}, array({', '.join(map(quote, tail))}))" for a, w, width, n, need, tail in rows
    )
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(label, word, t_width, t_size, need, t_tail)")


def _phrase_places(words: str, phrase: str) -> str:
    tests = " and ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(phrase.split()))
    return f"filter(transform({words}, (w, i) -> case when {tests} then i end), x -> x is not null)"


def find_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, share: float = 0.8
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every row.

    `matches` lists the templates found, with the best share of a window and the first place (0 is the text's first word) of
    the rarest template word of a window holding the template.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    order = token_order(docs, templates)
    rows = prefixes(templates, order, share)
    marks = sorted({w for _, w, *_ in rows})
    vocabulary = F.array(*map(F.lit, order))
    # For a prefix word: its place in the order and the least overlap that any of its templates needs.
    ranks = {w: order.index(w) + 1 for w in marks}
    needs = {w: min(r[4] for r in rows if r[1] == w) for w in marks}
    bounds = F.create_map(*[x for w in marks for x in (F.lit(w), F.struct(F.lit(ranks[w]).alias("rank"), F.lit(needs[w]).alias("need")))])

    spoken = "|".join(f"[{BREAKS}]+".join(p.split()) for p in phrases.values())
    words = F.when(F.col("text").rlike(f"(?i)(?:{spoken})"), words_of(F.col("text")))
    # A mark is a whole word; case is that of ASCII, as in words_of.
    marked = f"(?i)(?:^|[{BREAKS}])(?:{'|'.join(marks)})(?:[{BREAKS}]|$)"
    side = max(r[2] for r in rows) - 1

    def spot(word: Column, i: Column) -> Column:
        start = F.greatest(i - side, F.lit(0))
        around = F.slice("_all", start + 1, i - start + 1 + side)
        bound = F.element_at(bounds, word)
        later = F.slice(vocabulary, bound["rank"], len(order))
        enough = F.size(F.array_intersect(later, around)) >= bound["need"]
        return F.when(word.isin(marks) & enough, F.struct(i.alias("place"), word.alias("word"), (i - start).alias("at"), around.alias("around")))

    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        words.alias("_words"),
        F.when(F.col("text").rlike(marked), words_of(F.col("text"))).alias("_all"),
    )
    spots = F.filter(F.transform("_all", spot), lambda x: x.isNotNull())
    places = {k: F.coalesce(F.expr(_phrase_places("_words", p)), F.array().cast("array<int>")) for k, p in phrases.items()}
    base = base.select(
        "row", "doc_id", "n_words", spots.alias("spots"), F.struct(*[x.alias(k) for k, x in places.items()]).alias("_places")
    )
    base = settle(base, "license-base")

    near = base.select("row", F.explode("spots").alias("s")).select("row", "s.*")
    pairs = near.join(_prefix_table(docs, rows), "word").where("size(array_intersect(t_tail, around)) >= need")
    # Every window of the template's width that holds the prefix word; `at` counts from 0, slice from 1.
    held = F.expr(
        "array_max(transform(sequence(greatest(at + 2 - t_width, 1), at + 1),"
        " i -> size(array_intersect(t_tail, slice(around, i, t_width)))))"
    )
    found = (
        pairs.withColumn("held", held)
        .where("held >= need")
        .groupBy("row", "label")
        .agg(F.min("place").alias("word"), F.max(F.col("held") / F.col("t_size")).alias("share"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("label", "word", "share")).alias("matches"))
    )
    every = F.flatten(F.array(*[F.col(f"_places.`{k}`") for k in phrases]))
    spoken_labels = F.array_compact(F.array(*[F.when(F.size(F.col(f"_places.`{k}`")) > 0, k) for k in sorted(phrases)]))
    out = base.drop("spots").join(found, "row", "left").withColumn("_every", every).withColumn("_base", spoken_labels)
    out = out.withColumn("matches", F.coalesce(F.array_sort("matches"), F.array().cast(found.schema["matches"].dataType)))
    return out.select(
        "doc_id",
        "n_words",
        F.size("_every").cast("long").alias("n_base"),
        F.array_min("_every").cast("long").alias("first_word"),
        F.array_max("_every").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.expr("transform(matches, m -> m.label)"))), ",").alias("labels"),
        F.greatest(
            F.when(F.size("_every") > 0, 1.0).otherwise(0.0),
            F.coalesce(F.expr("array_max(transform(matches, m -> m.share))"), F.lit(0.0)),
        ).alias("score"),
        "matches",
    )
