"""License notices in documents: fixed phrases, and an exact set-similarity join.

A template is a notice as a set of ``n`` words. It is met by a run of consecutive
words, over line ends too, that begins with one of its words, is at most a
quarter longer than the notice, and holds a threshold share of its words. Where
licenses share their wording, words that tell them apart must be in the run, or
must not (``APART``).

Texts are cut into overlapping blocks that hold each such run whole, and blocks
and templates are joined as sets. Words of templates have one global order,
rarest first. A block with ``need`` of a template's words must

- hold one of the template's first ``n - need + 1`` words (prefix filter),
- have ``need`` words of templates at all (length filter), and
- have enough words left in both, at the place of their first shared word in the
  global order, to reach ``need`` (positional filter).

All three are exact, so no block that meets the threshold is missed; the runs of
blocks that do are then measured one by one.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.session import write_and_reread

from .text import SEPARATORS, let, words_of

# Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as their licenses word them.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
    ],
    "apache": [
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "released under the bsd license",
    ],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nc-sa": ["licensed under cc by nc sa 4.0"],
    "cc-by-nd": ["licensed under cc by nd 4.0"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "gpl": [
        "licensed under the gnu general public license version 3",
        "under the terms of the gnu general public license as published by the free software foundation",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": [
        "licensed under the gnu lesser general public license version 3",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["subject to the terms of the mozilla public license version 2.0"],
    "rights-reserved": ["all rights reserved"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

# What tells licenses of like wording apart: groups of words of
# which each must give one, and words that must not be there.
APART = {
    "agpl": ([["affero"]], []),
    "apache": ([["apache", "file"]], []),
    "bsd": ([["bsd", "redistribution"]], []),
    "cc-by": ([], ["nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike"]),
    "cc-by-nc": ([["nc", "noncommercial"]], ["nd", "sa", "noderivatives", "sharealike"]),
    "cc-by-nc-sa": ([["nc"], ["sa"]], ["nd"]),
    "cc-by-nd": ([["nd"]], ["nc", "sa"]),
    "cc-by-sa": ([["sa", "sharealike"]], ["nc", "nd", "noncommercial", "noderivatives"]),
    "gpl": ([], ["affero", "lesser", "library"]),
    "lgpl": ([["lesser"]], ["affero"]),
    "mit": ([["mit", "permission"]], []),
    "mpl": ([["mozilla"]], []),
}
CONTAINMENT = 0.8
#: A run may be so many times as long as the notice.
SPAN = 1.25
#: Words that a block adds to those of the block before, at least.
BLOCK = 128
#: Templates are few by nature; more words than this are joined by shuffle.
BROADCAST_WORDS = 100_000


def template_rows(spark, templates: dict[str, list[str]] = TEMPLATES, apart: dict = APART, span: float = SPAN) -> DataFrame:
    """(template, label, words, span, needed, never): distinct words of each template, words of a run, and what tells it apart."""
    flat = [(label, text) for label, texts in sorted(templates.items()) for text in texts]
    rows = [(i, label, text, *apart.get(label, ([], []))) for i, (label, text) in enumerate(flat)]
    listed = spark.createDataFrame(rows, "template int, label string, text string, needed array<array<string>>, never array<string>")
    words = words_of(F.col("text"))
    return listed.select(
        "template", "label", F.array_distinct(words).alias("words"), F.floor(F.size(words) * F.lit(span)).cast("int").alias("span"), "needed", "never"
    ).where(F.size("words") > 0)


def containment_join(
    blocks: DataFrame, templates: DataFrame, tokens: DataFrame | None = None, threshold: float = CONTAINMENT, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Blocks that hold at least ``threshold`` of a template's words.

    ``blocks`` has ``words`` (may repeat) and any other columns, ``templates``
    is (template, label, words) with distinct words, ``tokens`` has every word
    of the corpus in ``word`` (all words of the blocks, if left out). Returns
    the other columns, template, label, shared and share, and the columns of
    ``carry``: ``words``, ``all_words`` (the template's), or others of
    ``templates``. Order and repetition of words in a block do not count; empty
    blocks meet nothing. A block whose ``words`` are null is no block: it comes
    back once, with null in the rest.
    """
    extra = [c for c in carry if c in templates.columns and c != "words"]
    template_words = write_and_reread(
        templates.select("template", "label", *extra, F.size("words").alias("n"), F.explode("words").alias("word")), "template_words"
    )
    small = template_words.count() <= BROADCAST_WORDS
    bound = F.broadcast if small else (lambda df: df)
    if tokens is None:
        tokens = blocks.select(F.explode("words").alias("word"))
    # How often each template word occurs: summed before the shuffle, one row per word of the templates.
    vocabulary = template_words.select("word").distinct()
    held = tokens.join(bound(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("held"))
    frequency = write_and_reread(vocabulary.join(held, "word", "left").select("word", F.coalesce("held", F.lit(0)).alias("held")), "frequency")
    place = F.row_number().over(Window.partitionBy("template").orderBy("held", "word"))
    need = F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")
    ordered = template_words.join(bound(frequency), "word").withColumn("i", place).withColumn("need", need)
    whole = ordered.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("i", "word")))["word"].alias("all_words"))
    prefix = ordered.where(F.col("i") <= F.col("n") - F.col("need") + 1).join(whole, "template")
    prefix = write_and_reread(prefix.select("word", "template", "label", "n", "need", "i", "all_words", *extra), "prefixes")
    # The words of all templates in the global order: one row, as large as the templates.
    order = frequency.agg(F.array_sort(F.collect_list(F.struct("held", "word")))["word"].alias("order")).scalar()
    keep = [c for c in blocks.columns if c != "words"]
    known = blocks.select(*blocks.columns, F.array_intersect(order, "words").alias("known"))
    matched = known.select("*", F.posexplode_outer("known").alias("j", "word")).join(bound(prefix), "word", "left").where(
        F.col("words").isNull() | F.col("template").isNotNull()
    )
    size = F.size("known")
    long_enough = size >= F.col("need")
    # The match itself and what is left behind it, in the template (i from 1) and in the block (j from 0).
    enough_left = F.least(F.col("n") - F.col("i") + 1, size - F.col("j")) >= F.col("need")
    shared = F.array_intersect("all_words", "known")
    scored = matched.where(F.col("words").isNull() | (long_enough & enough_left)).select(
        *keep, "words", "word", "template", "label", "n", "need", "all_words", *extra, shared.alias("both")
    )
    # A pair comes once, at its first shared word.
    met = (F.size("both") >= F.col("need")) & (F.get("both", F.lit(0)) == F.col("word"))
    n_shared = F.when(F.col("words").isNotNull(), F.size("both"))
    return scored.where(F.col("words").isNull() | met).select(
        *keep, "template", "label", n_shared.alias("shared"), (n_shared / F.col("n")).alias("share"), *carry
    )


def best_run(words: Column, all_words: Column, span: Column, needed: Column, never: Column, starts: int) -> Column:
    """The most words of a template in a run that begins at one of the first ``starts`` words; null if no run counts."""

    def held(start):
        def measured(run):
            counts = F.forall(needed, lambda some: F.arrays_overlap(some, run)) & ~F.arrays_overlap(never, run)
            return F.when(counts, F.size(F.array_intersect(all_words, run)))

        return let(F.slice(words, start, span), measured)

    own = F.sequence(F.lit(1), F.least(F.size(words), F.lit(starts)))
    return F.array_max(F.transform(F.filter(own, lambda k: F.array_contains(all_words, F.element_at(words, k))), held))


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively, from 0."""
    parts = phrase.split()

    def here(i):
        return reduce(lambda a, b: a & b, [F.get(words, i + j) == part for j, part in enumerate(parts)])

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _document(words: Column, block: int, reach: int) -> Column:
    """Base facts of a document from its words, and its blocks: ``block`` words and the next ``reach``."""
    none = F.array().cast("array<int>")
    found = [F.when(F.array_contains(words, phrase.split()[-1]), _places(words, phrase)).otherwise(none) for phrase in PHRASES]
    labels = [F.when(F.size(places) > 0, F.lit(label)) for places, label in zip(found, PHRASES.values(), strict=True)]
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(block))).otherwise(none)
    return F.struct(
        F.size(words).cast("long").alias("n_words"), F.array_sort(F.concat(*found)).alias("places"),
        F.array_compact(F.array(*labels)).alias("base"), F.transform(starts, lambda k: F.slice(words, k, block + reach)).alias("blocks"),
    )


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, threshold: float = CONTAINMENT) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text) with its license labels.

    ``templates`` has the columns of ``template_rows``. Returns doc_id, n_words,
    n_base, first_word, last_word, base_labels, labels, score. The score is 1
    with a base phrase, else the greatest share of a template that a run of
    words meets, else 0. Null texts have no words; a document without labels has
    empty label strings. Repeated rows stay repeated.
    """
    if templates is None:
        templates = template_rows(docs.sparkSession)
    longest = templates.agg(F.max("span")).first()[0] or 1
    block = max(BLOCK, longest)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Only for the order of template words, so plain lower case will do.
    tokens = docs.select(F.explode(F.split(F.lower(text), SEPARATORS)).alias("word"))
    facts = docs.select(
        "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), let(words_of(text), lambda words: _document(words, block, longest - 1)).alias("b")
    )
    own_row = F.array(F.lit(None).cast("array<string>"))
    rows = facts.select("doc_id", "text_hash", "b.n_words", "b.places", "b.base", F.explode(F.concat(own_row, "b.blocks")).alias("words"))
    joined = containment_join(rows, templates, tokens, threshold, ("words", "all_words", "span", "needed", "never"))
    best = best_run(F.col("words"), F.col("all_words"), F.col("span"), F.col("needed"), F.col("never"), block)
    run = F.when(F.col("template").isNotNull(), best / F.size("all_words"))
    found = write_and_reread(joined.withColumn("run", run).drop("words", "all_words", "span", "needed", "never"), "notices")
    met = found.where(F.col("run") >= F.lit(threshold) - 1e-9).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("met_labels"), F.max("run").alias("share")
    ).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    more = F.coalesce("met_labels", F.array().cast("array<string>"))
    some = F.size("places") > 0
    return found.where("template IS NULL").select("doc_id", "text_hash", "n_words", "places", "base").join(met, same, "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.when(some, F.element_at("places", 1)).cast("long").alias("first_word"),
        F.when(some, F.element_at("places", -1)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
