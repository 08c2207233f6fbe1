"""Licence scan through a positional index of rare licence words.

The templates are few and fixed. One pass counts in how many documents each licence word stands; from
that follows each word's IDF. Every template is indexed under its highest-IDF words only: so many that
no stretch which holds ``share`` of the template's IDF weight can miss them all. A file looks up its
words there, and the postings found are intersected by relative position (file position less template
position). A word may drift: it counts within one place of its own for every ``DRIFT_WORDS`` words of the
template, ``DRIFT`` at most, so that a notice with a word more or less is still found; one file word may
stand for two equal words of the template. A stretch that reaches ``share`` counts if every mandatory key
phrase stands in it word for word. Base phrases are templates that must be there whole and in place.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows each give a
row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and the labels that they give.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Label, template, mandatory key phrases: sentences of the licences' own notices and headers.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache", "2 0"]),
    ("apache-2.0", "apache license version 2 0 january 2004", ["apache license", "2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "the mit license mit", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("lgpl", "the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "the gnu affero general public license", ["affero general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license", "2 0"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ["will the authors be held liable"]),
]
#: Identifiers of licence tags; each makes a template, the whole of which is mandatory.
TAGS = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]


def tag_template(name: str) -> tuple[str, str, list[str]]:
    text = f"spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}"
    return name.lower(), text, [text]


TEMPLATES = NOTICES + [tag_template(name) for name in TAGS]
SHARE = 0.8
#: Words by which a template word may stand before or after its place, at most, and template words for each.
DRIFT, DRIFT_WORDS = 2, 4
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def drift_of(template: list[bytes]) -> int:
    return min(DRIFT, len(template) // DRIFT_WORDS)


class Index:
    """Postings of each template under its rarest words."""

    def __init__(self, df: dict[bytes, int], n_docs: int, share: float = SHARE):
        self.templates = [(label, words_of(p.encode()), [], 1.0, 0) for p, label in BASE.items()]
        self.templates += [(label, ws, [words_of(k.encode()) for k in keys], share, drift_of(ws)) for label, t, keys in TEMPLATES for ws in [words_of(t.encode())]]
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary()}
        self.total = [sum(self.idf[w] for w in ws) for _, ws, _, _, _ in self.templates]
        self.postings: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        self.rarest = []
        for t, (_, ws, _, least, drift) in enumerate(self.templates):
            missed = 0.0
            self.rarest.append(sorted(range(len(ws)), key=lambda i: (-self.idf[ws[i]], i)))
            for at in self.rarest[t]:
                if missed > (1 - least) * self.total[t] + 1e-9:
                    break
                self.postings[ws[at]].append((t, at, drift))
                missed += self.idf[ws[at]]

    def scan(self, words: list[bytes]) -> dict:
        places: dict[bytes, set[int]] = defaultdict(set)
        for i, w in enumerate(words):
            if w in self.idf:
                places[w].add(i)
        starts = {(t, i - at + d) for w in places.keys() & self.postings.keys() for t, at, drift in self.postings[w] for i in places[w] for d in range(-drift, drift + 1)}
        base: list[int] = []
        base_labels, labels, score = set(), set(), 0.0
        for t, start in starts:
            label, ws, keys, least, drift = self.templates[t]
            spare = (1 - least) * self.total[t] + 1e-9
            for j in self.rarest[t]:
                here = places.get(ws[j], ())
                if not any(start + j + d in here for d in range(-drift, drift + 1)):
                    spare -= self.idf[ws[j]]
                    if spare < 0:
                        break
            if spare < 0:
                continue
            if t < len(BASE):
                base.append(start)
                base_labels.add(label)
                score = 1.0
                continue
            stretch = words[max(0, start - drift) : start + len(ws) + drift]
            if all(any(stretch[i : i + len(k)] == k for i in range(len(stretch))) for k in keys):
                labels.add(label)
                score = max(score, min(1.0, least + (spare - 1e-9) / self.total[t]))
        score = math.floor(score * 1e6 + 0.5) / 1e6
        return {"n_words": len(words), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None), "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | labels)), "score": score}


def vocabulary() -> list[bytes]:
    return sorted({w for t in [*BASE, *(t for _, t, _ in TEMPLATES)] for w in words_of(t.encode())})


def word_counts(rows: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, and the number of documents. As many numbers as there are licence words reach the driver."""
    vocab = {w: i for i, w in enumerate(vocabulary())}
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * (len(vocab) + 1)
        for batch in batches:
            n[-1] += batch.num_rows
            for text in batch.column("text").cast(pa.binary()):
                for w in vocab.keys() & set(words_of(text.as_py())):
                    n[vocab[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], schema=schema)

    found = {r.word: r.n for r in rows.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(i, 0) for w, i in vocab.items()}, found.get(len(vocab), 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df, n = word_counts(rows.select("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    schema = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n, share)
        for batch in batches:
            found = [index.scan(words_of(text.as_py())) for text in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[name] for f in found], kind) for name, kind in fields)], schema=schema)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def sql() -> str:
    """The same rows from DuckDB, templates and all."""
    rows = [(t, label, words_of(text.encode()), [], 1.0, 0) for t, (text, label) in enumerate(BASE.items())]
    rows += [(len(BASE) + t, label, ws, keys, SHARE, drift_of(ws)) for t, (label, text, keys) in enumerate(TEMPLATES) for ws in [words_of(text.encode())]]
    words = ", ".join(f"({t}, {at}, '{w.decode()}')" for t, _, ws, _, _, _ in rows for at, w in enumerate(ws))
    kinds = ", ".join(f"({t}, '{label}', {len(ws)}, [{', '.join(repr(k) for k in keys)}]::VARCHAR[], {least}, {t < len(BASE)}, {drift})" for t, label, ws, keys, least, drift in rows)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tw(t, k, w) AS (VALUES {words}),
tk(t, label, n, keys, least, base, drift) AS (VALUES {kinds}),
p AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
hit AS (SELECT p.rid, p.pos, p.w FROM p WHERE p.w IN (SELECT w FROM tw)),
idf AS (SELECT v.w, ln((n.n + 1) / (coalesce(f.df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN (SELECT w, count(DISTINCT rid) AS df FROM hit GROUP BY w) f ON f.w = v.w, (SELECT count(*) AS n FROM d) n),
tot AS (SELECT t, sum(idf) AS total FROM tw JOIN idf ON idf.w = tw.w GROUP BY t),
near AS (SELECT DISTINCT h.rid, tw.t, h.pos - tw.k + o.d AS start, tw.k, h.w FROM hit h JOIN tw ON tw.w = h.w JOIN tk ON tk.t = tw.t JOIN (SELECT unnest(range(-2, 3)) AS d) o ON abs(o.d) <= tk.drift),
lined AS (SELECT n.rid, n.t, n.start, sum(idf.idf) AS got, count(*) AS m FROM near n JOIN idf ON idf.w = n.w GROUP BY ALL),
cand AS (SELECT l.rid, tk.label, tk.base, l.start, l.got / tot.total AS share, tk.keys, array_to_string(d.ws[greatest(l.start - tk.drift, 0) + 1:l.start + tk.n + tk.drift], ' ') AS stretch
         FROM lined l JOIN tk ON tk.t = l.t JOIN tot ON tot.t = l.t JOIN d ON d.rid = l.rid WHERE CASE WHEN tk.base THEN l.m = tk.n ELSE l.got / tot.total >= tk.least - 1e-9 END),
ok AS (SELECT * FROM cand WHERE base OR len(list_filter(keys, lambda k: NOT contains(' ' || stretch || ' ', ' ' || k || ' '))) = 0),
agg AS (
    SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN base THEN 1.0 ELSE least(1.0, share) END) AS score FROM ok GROUP BY rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, floor(coalesce(score, 0.0) * 1000000.0 + 0.5) / 1000000.0 AS score
FROM d LEFT JOIN agg ON agg.rid = d.rid
"""
