"""License scans: an exact set-similarity join of text blocks with license templates.

A text is cut into words, and the words into overlapping blocks that start every half block, so that a notice of up
to half a block lies whole within one. There are two sizes: `BLOCK_WORDS` for notices of one line (`TEMPLATES`), and
`NOTICE_WORDS`, twice the longest one, for whole notices (`NOTICES`). A block matches a template if it holds at least
`THRESHOLD` of the template's distinct words (containment). The join is exact: tokens are put in one global order by
how often they occur in all texts, rarest first, and

* prefix filter: with overlap o = ceil(THRESHOLD * n) asked of a template of n tokens, a block that misses all
  of the template's first n - o + 1 tokens can't match; only those tokens are indexed and probed;
* length filter: a block of fewer than o distinct tokens can't match;
* positional filter: a first common token at place i in the template and j in the block leaves at most
  min(n - i, |block| - j) common tokens, which must reach o;

and what remains is counted in full. The templates are a fixed list, so index and order are broadcast in the
function; what grows (the texts) is only ever streamed, block by block.

Sets can't tell notices of one family apart that differ by a few words (`FAMILIES`). So what a block matches is then
held against its words in order: of a family's matches in a block those stay that hold the greatest part of their
distinct runs of `RUN` words; a notice that is another one with more to it (`EXTENDS`) stands for both; and a line that
a whole notice over the same words contains (`EXPLAINED`) is told by the notice alone.

Defined results: a null or empty text has no words, no places, no labels and score 0; repeated rows are scanned
one by one; a text of many blocks is scanned block by block, whatever its length; of equal parts all labels
of a family count; an empty table gives an empty table; only the id and text columns are read, whatever else there is.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.session import table

BLOCK_WORDS, BLOCK_STEP, THRESHOLD = 32, 16, 0.9

# Public license notices and the labels given to them.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
]
# Whole public notices and the labels given to them; names and years of holders are left out.
NOTICES = [
    (
        "agpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details you should have received a copy of the gnu "
        "affero general public license along with this program if not see https www gnu org licenses",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache "
        "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
        "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
        "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    (
        "cc-by-nc-4.0",
        "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0",
    ),
    (
        "cc-by-sa-4.0",
        "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0",
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version "
        "2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with "
        "this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa",
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version "
        "3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with "
        "this program if not see https www gnu org licenses",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
        "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "lgpl-3.0",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general "
        "public license along with this library if not see https www gnu org licenses",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
        "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form "
        "or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
]
#: Twice the longest notice, so that it lies whole within one of the blocks that start every half.
NOTICE_WORDS = 2 * max(len(text.split()) for _, text in NOTICES)
# Phrases whose words must stand side by side, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Families of licenses whose notices are alike, and notices that hold a whole other one.
FAMILIES = {
    "agpl-3.0": "gnu", "gpl-2.0": "gnu", "gpl-3.0": "gnu", "lgpl-3.0": "gnu", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "cc-by-4.0": "cc", "cc-by-nc-4.0": "cc", "cc-by-sa-4.0": "cc",
}
EXTENDS = {"bsd-3-clause": "bsd-2-clause"}
#: Words in a run by which siblings are told apart.
RUN = 3

_WORD = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, as UTF-8: runs of digits, letters a-z and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def runs_of(words: list[bytes]) -> set[tuple]:
    return set(zip(*(words[i:] for i in range(RUN))))


def explained(lines: list[tuple[str, str]], notices: list[tuple[str, str]], threshold: float) -> set[tuple[str, str]]:
    """(label of a line, label of a notice) for each notice that matches the line by its own words, under another label."""
    sets = [(label, set(words_of(text))) for label, text in notices]
    return {(label, other) for label, text in lines for other, held in sets if label != other and len(held & (own := set(words_of(text)))) >= math.ceil(round(threshold * len(own), 9))}


EXPLAINED = explained(TEMPLATES, NOTICES, THRESHOLD)


class Index:
    """Templates in the global order, and their prefixes by token."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        tokens = [(label, sorted(set(words_of(text)), key=lambda t: (counts.get(t, 0), t))) for label, text in templates]
        self.rank = {t: i for i, t in enumerate(sorted({t for _, ts in tokens for t in ts}, key=lambda t: (counts.get(t, 0), t)))}
        self.templates = [(label, [self.rank[t] for t in ts], math.ceil(round(threshold * len(ts), 9))) for label, ts in tokens]
        self.runs = {label: runs_of(words_of(text)) for label, text in templates}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, ts) in enumerate(tokens):
            for i, t in enumerate(ts[: len(ts) - self.templates[k][2] + 1]):
                self.prefix.setdefault(t, []).append((k, i))

    def match(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of the templates that the block's words match."""
        distinct = set(block)
        known = sorted(self.rank[t] for t in distinct if t in self.rank)
        at = {r: j for j, r in enumerate(known)}
        seen = set()
        for t in sorted((t for t in distinct if t in self.prefix), key=self.rank.__getitem__):
            j = at[self.rank[t]]
            for k, i in self.prefix[t]:
                label, ranks, least = self.templates[k]
                if k in seen or len(known) < least:
                    continue
                seen.add(k)
                if min(len(ranks) - i, len(known) - j) >= least and (n := sum(r in at for r in ranks)) >= least:
                    yield label, n / len(ranks)


    def told_apart(self, block: list[bytes]) -> list[tuple[str, float]]:
        """The block's matches without siblings that the order of its words speaks against."""
        found = list(self.match(block))
        if len(found) < 2:
            return found
        base = {EXTENDS[label] for label, _ in found if label in EXTENDS}
        found = [x for x in found if x[0] not in base]
        held, best = None, {}
        kin = Counter(FAMILIES.get(label) for label, _ in found)
        part = {}
        for label, _ in found:
            if (family := FAMILIES.get(label)) and kin[family] > 1:
                held = runs_of(block) if held is None else held
                part[label] = len(self.runs[label] & held) / max(1, len(self.runs[label]))
                best[family] = max(best.get(family, 0.0), part[label])
        return [x for x in found if x[0] not in part or part[x[0]] == best[FAMILIES[x[0]]]]


def scan(words: list[bytes], index: Index, width: int) -> list[tuple[int, str, float]]:
    """(first word of the block, label, containment) of every match; only blocks with a prefix token are built."""
    step = width // 2
    last = max(0, -(-(len(words) - width) // step))
    starts = set()
    for i, w in enumerate(words):
        if w in index.prefix:
            k = min(i // step, last)
            starts.update(x * step for x in range(max(0, (i - width) // step + 1), k + 1))
    return [(s, label, c) for s in sorted(starts) for label, c in index.told_apart(words[s : s + width])]


def without_explained(lines: list[tuple[int, str, float]], notices: list[tuple[int, str, float]], pairs: set) -> list[tuple[int, str, float]]:
    """Matches of lines but those over whose words a notice lies that contains the line."""
    return [x for x in lines if not any((x[1], label) in pairs and x[0] < at + NOTICE_WORDS and at < x[0] + BLOCK_WORDS for at, label, _ in notices)]


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand side by side."""
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES:
        asked = b" " + phrase.encode() + b" "
        at, done, n = joined.find(asked), 0, 0
        while at >= 0:
            n += joined.count(b" ", done, at)
            done = at
            found.append((n, label))
            at = joined.find(asked, at + 1)
    return sorted(found)


def token_counts(df: DataFrame, templates: list, text: str = "text") -> dict[bytes, int]:
    """How often each template token occurs in all texts: a few numbers per task, summed by Spark."""
    asked = {t for _, x in templates for t in words_of(x)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total.update(filter(asked.__contains__, words_of(x)))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = df.select(text).mapInArrow(count, "token binary, n long").groupBy("token").sum("n").collect()
    return {bytes(r[0]): r[1] for r in rows}


def license_matches(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list | None = None, notices: list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per text: n_words, the phrase places and the matching blocks as arrays of structs."""
    short, long = TEMPLATES if templates is None else templates, NOTICES if notices is None else notices
    counts = token_counts(df, [*short, *long], text)
    lines, whole, pairs = Index(short, counts, threshold), Index(long, counts, threshold), explained(short, long, threshold)
    id_type = df.schema[doc_id].dataType.simpleString()
    places_type = pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())]))
    blocks_type = pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places, blocks = [], [], []
            for x in batch.column(1).to_pylist():
                words = words_of(x)
                n.append(len(words))
                places.append([{"at": a, "label": b} for a, b in phrase_places(words)])
                over = scan(words, whole, NOTICE_WORDS)
                blocks.append([{"at": a, "label": b, "containment": c} for a, b, c in [*without_explained(scan(words, lines, BLOCK_WORDS), over, pairs), *over]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, places_type), pa.array(blocks, blocks_type)], ["doc_id", "n_words", "places", "blocks"])

    out = f"doc_id {id_type}, n_words long, places array<struct<at:long,label:string>>, blocks array<struct<at:long,label:string,containment:double>>"
    return df.select(doc_id, text).mapInArrow(run, out)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(places) as long) as n_base",
        "array_min(places.at) as first_word",
        "array_max(places.at) as last_word",
        "array_join(array_sort(array_distinct(places.label)), ',') as base_labels",
        "array_join(array_sort(array_union(places.label, blocks.label)), ',') as labels",
        "case when size(places) > 0 then 1.0D else coalesce(array_max(blocks.containment), 0.0D) end as score",
    )


_TEMPLATE_ROWS = ", ".join(f"('{kind}:{label}', '{word}', {width // 2})" for kind, made, width in (("line", TEMPLATES, BLOCK_WORDS), ("notice", NOTICES, NOTICE_WORDS)) for label, text in made for word in sorted(set(text.split())))
_RUN_ROWS = ", ".join(f"('{kind}:{label}', '{a}', '{b}', '{c}')" for kind, made in (("line", TEMPLATES), ("notice", NOTICES)) for label, text in made for a, b, c in sorted(set(zip(text.split(), text.split()[1:], text.split()[2:]))))
_KIN_ROWS = ", ".join(f"('{kind}:{label}', '{family}')" for kind in ("line", "notice") for label, family in FAMILIES.items())
_EXPLAINED_ROWS = ", ".join(f"('line:{a}', 'notice:{b}')" for a, b in sorted(EXPLAINED))
_PHRASE_ROWS = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in PHRASES)
#: DuckDB: explode words, group the template words of each block, and compare counts; no filters. Then siblings, by runs of words.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), tpl(label, token, step) AS (VALUES {_TEMPLATE_ROWS}
), sz AS (SELECT label, count(*) AS n FROM tpl GROUP BY label
), phrase(words, label, n) AS (VALUES {_PHRASE_ROWS}
), w AS (
  SELECT rid, len(words) AS total, i - 1 AS i, words[i] AS token, words[i + 1] AS t1, words[i + 2] AS t2
  FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM d)
), p AS (
  SELECT rid, i, label FROM w JOIN phrase ON (n = 2 AND token || ' ' || t1 = phrase.words) OR (n = 3 AND token || ' ' || t1 || ' ' || t2 = phrase.words)
), pa AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS ls FROM p GROUP BY rid
), b AS (
  SELECT DISTINCT rid, k, label, w.token FROM w JOIN tpl ON w.token = tpl.token, unnest([0, 1]) AS s(back), LATERAL (SELECT i // step - back AS k)
  WHERE k >= 0 AND k * step <= i AND i < k * step + 2 * step AND k <= greatest(0, ceil((total - 2 * step) / step))
), m0 AS (
  SELECT rid, k, b.label, count(*) / max(n) AS c FROM b JOIN sz ON b.label = sz.label GROUP BY rid, k, b.label HAVING count(*) >= ceil(round({THRESHOLD} * max(n), 9))
), m1 AS (
  SELECT m0.*, split_part(label, ':', 1) AS kind, CASE WHEN label LIKE 'notice:%' THEN {NOTICE_WORDS // 2} ELSE {BLOCK_WORDS // 2} END AS step FROM m0
  WHERE NOT EXISTS (SELECT 1 FROM m0 x WHERE x.rid = m0.rid AND x.k = m0.k AND split_part(x.label, ':', 1) = split_part(m0.label, ':', 1) AND split_part(x.label, ':', 2) = 'bsd-3-clause' AND split_part(m0.label, ':', 2) = 'bsd-2-clause')
), run(label, x, y, z) AS (VALUES {_RUN_ROWS}
), kin(label, family) AS (VALUES {_KIN_ROWS}
), part AS (
  SELECT m1.rid, m1.k, m1.kind, m1.label, family, count(DISTINCT run.x || ' ' || run.y || ' ' || run.z) FILTER (w.rid IS NOT NULL) / count(DISTINCT run.x || ' ' || run.y || ' ' || run.z) AS share
  FROM m1 JOIN kin ON kin.label = m1.label JOIN run ON run.label = m1.label LEFT JOIN w ON w.rid = m1.rid AND w.token = run.x AND w.t1 = run.y AND w.t2 = run.z AND w.i >= m1.k * step AND w.i + 2 < m1.k * step + 2 * step
  GROUP BY m1.rid, m1.k, m1.kind, m1.label, family
), less AS (
  SELECT rid, k, kind, label FROM part QUALIFY share < max(share) OVER (PARTITION BY rid, k, kind, family)
), m2 AS (
  SELECT * FROM m1 WHERE NOT EXISTS (SELECT 1 FROM less WHERE less.rid = m1.rid AND less.k = m1.k AND less.label = m1.label)
), explained(line, notice) AS (VALUES {_EXPLAINED_ROWS}
), m AS (
  SELECT rid, label, c FROM m2 WHERE NOT EXISTS (SELECT 1 FROM m2 x JOIN explained ON notice = x.label WHERE line = m2.label AND x.rid = m2.rid AND m2.k * m2.step < x.k * x.step + 2 * x.step AND x.k * x.step < m2.k * m2.step + 2 * m2.step)
), ma AS (SELECT rid, max(c) AS c, list_distinct(list(split_part(label, ':', 2))) AS ls FROM m GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(pa.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(pa.ls, []), coalesce(ma.ls, [])))), ',') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(ma.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN pa USING (rid) LEFT JOIN ma USING (rid)
"""
