"""Operator 8: licence scans with DataFrame functions only.

Whole texts are cut into lines and sentences; those that hold a licence cue are headers. A file whose name is that of a licence
file is also compared as a whole, and by its paragraphs, with whole licences and the titles of those too long to be given here. Headers, paragraphs, files and
templates become TF-IDF vectors, weighted by how many of them hold each word, and each
takes the licence of the template with the greatest cosine, if that is at least MIN_COSINE. A file's
licence is that of its best part. Files without one inherit from the nearest ancestor directory that
holds a licence file with a known licence, by joins on directory paths.

Null and empty texts have no parts; files with a null path can't inherit. Ties go to the template
first in the list, licence files to the smaller id. Repeated ids are one file (the greatest cosine counts), given once for each row.
An empty table gives no rows. Very long texts are cut like others. Other columns of the input are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.llm.common import materialize, salted

MIN_COSINE = 0.6
CUE = r"(?i)licen[sc]|copyright|spdx|permission is hereby granted|redistribution and use in source|used to endorse or promote|dedicated to the public domain"
SPLIT = r"\n|[.!?] "
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"

PARAGRAPH = r"\n[ \t\r]*\n"

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = (
    "Copyright All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Whole licences, with which whole licence files are compared, and the openings of those that are too long.
WHOLE: list[tuple[str, str]] = [
    ("MIT", "MIT License Copyright Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License Copyright " + _GRANT + " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", _BSD + "3. " + _ENDORSE + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
]

#: Short notices by which each licence is known in any file. The clause on endorsements, which comes before the ones that both share, tells the three-clause licence from the other.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", _ENDORSE.rstrip(".")),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _vectors(terms: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """Unit TF-IDF vectors: keys, term_, x_."""
    counted = terms.groupBy(*keys, "term_").agg(F.count(F.lit(1)).alias("tf_"))
    weighed = counted.join(idf, "term_").withColumn("w_", F.col("tf_") * F.col("idf_"))
    return weighed.withColumn("x_", F.col("w_") / F.sqrt(F.sum(F.col("w_") * F.col("w_")).over(Window.partitionBy(*keys)))).select(*keys, "term_", "x_")


def scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, license, cosine, via (header, directory, none), origin_id for each row."""
    spark = files.sparkSession
    rows = files.select(F.col(key).alias("id_"), F.col(path).alias("path_"), F.col(text).alias("text_"))
    name = F.regexp_extract("path_", r"([^/]*)$", 1)
    cut = rows.filter(F.col("text_").rlike(CUE)).select("id_", F.filter(F.split("text_", SPLIT), lambda s: s.rlike(CUE)).alias("parts_"), F.lit("h").alias("kind_"))
    files_ = rows.filter(name.rlike(LICENCE_FILE) & F.col("text_").isNotNull()).select("id_", F.concat(F.array("text_"), F.split("text_", PARAGRAPH)).alias("parts_"), F.lit("f").alias("kind_"))
    headers = materialize(cut.unionByName(files_).select("id_", "kind_", F.posexplode("parts_").alias("at_", "header_")), "licence-headers")
    own = headers.select("id_", "kind_", "at_", F.explode(words(F.col("header_"))).alias("term_"))
    given = [*(("h", *x) for x in TEMPLATES), *(("f", *x) for x in WHOLE)]
    templates = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "t_ int, kind_ string, license_ string, text_ string").coalesce(1)
    known = templates.select("t_", "kind_", "license_", F.explode(words(F.col("text_"))).alias("term_"))
    vocabulary = known.select("term_").distinct()

    df = own.groupBy("term_").agg(F.count_distinct("id_", "kind_", "at_").alias("df_"))
    n = headers.count()
    idf = materialize(df.join(vocabulary, "term_", "full").select("term_", F.log(F.lit(1.0) + F.lit(n + len(given)) / (F.lit(1) + F.coalesce("df_", F.lit(0)))).alias("idf_")), "licence-idf")
    vectors = _vectors(own, idf, ["id_", "kind_", "at_"])
    shape = _vectors(known, idf, ["t_", "kind_", "license_"]).withColumnRenamed("x_", "y_")
    cosines = vectors.join(F.broadcast(shape), ["kind_", "term_"]).groupBy("id_", "kind_", "at_", "t_", "license_").agg(F.sum(F.col("x_") * F.col("y_")).alias("cos_"))  # templates are a fixed list
    cosines = cosines.withColumn("cos_", F.round("cos_", 4)).filter(F.col("cos_") >= MIN_COSINE)
    best = materialize(cosines.groupBy("id_").agg(F.max_by(F.struct("license_", "cos_"), F.struct("cos_", F.negative("t_"))).alias("b_")).select("id_", "b_.*"), "licence-files")

    folder = F.regexp_extract("path_", r"^(.*)/[^/]*$", 1)
    placed = rows.select("id_", "path_", folder.alias("folder_"), name.rlike(LICENCE_FILE).alias("file_"))
    placed = materialize(placed.join(best, "id_", "left"), "licence-placed")
    granted = placed.filter("file_ and license_ is not null").groupBy("folder_").agg(F.max_by(F.struct("license_", "cos_", "id_"), F.struct("cos_", F.negative("id_"))).alias("g_"))
    folders = placed.filter("license_ is null and folder_ is not null").groupBy("folder_").agg(F.count(F.lit(1)).alias("n_"))
    parts = F.split("folder_", "/")
    above = folders.select(F.col("folder_").alias("leaf_"), "n_", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth_"), F.array_join(F.slice(parts, 1, k), "/").alias("folder_")))).alias("a_")).select("leaf_", "n_", "a_.*")
    nearest = above.join(granted, "folder_").groupBy(F.col("leaf_").alias("folder_")).agg(F.max_by("g_", "depth_").alias("g_"), F.first("n_").alias("n_"))
    spread, nearest = salted(placed, nearest, "folder_", "n_", placed.count(), ["id_"])
    told = spread.join(nearest, ["folder_", "salt_"], "left")
    header, inherited = F.col("license_").isNotNull(), F.col("g_").isNotNull()
    return told.select(
        F.col("id_").alias(key),
        F.when(header, F.col("license_")).otherwise(F.col("g_.license_")).alias("license"),
        F.when(header, F.col("cos_")).otherwise(F.col("g_.cos_")).alias("cosine"),
        F.when(header, "header").when(inherited, "directory").otherwise("none").alias("via"),
        F.when(header, F.col("id_")).otherwise(F.col("g_.id_")).alias("origin_id"),
    )


def document_path() -> Column:
    """Documents have no paths: they are laid out as source / thousands / files, and every 64th number is its folder's licence file, or, every 1024th, that of the source."""
    i, s = F.col("doc_id"), F.coalesce("source", F.lit("unknown"))
    return F.when(i % 1024 == 0, F.concat(s, F.lit("/LICENSE"))).when(i % 64 == 0, F.concat(s, F.lit("/"), F.floor(i / 1024).cast("string"), F.lit("/LICENSE"))).otherwise(F.concat(s, F.lit("/"), F.floor(i / 1024).cast("string"), F.lit("/"), i.cast("string"), F.lit(".txt")))


def scan_sql() -> str:
    """The same over documents, for DuckDB."""
    given = [*(("h", *x) for x in TEMPLATES), *(("f", *x) for x in WHOLE)]
    values = ", ".join(f"({i}, '{k}', '{n}', '{t}')" for i, (k, n, t) in enumerate(given))
    return rf"""
    WITH templates(t, kind, lic, txt) AS (VALUES {values}),
    rows_ AS (SELECT doc_id, text, CASE WHEN doc_id % 1024 = 0 THEN coalesce(source, 'unknown') || '/LICENSE' WHEN doc_id % 64 = 0 THEN coalesce(source, 'unknown') || '/' || (doc_id // 1024) || '/LICENSE' ELSE coalesce(source, 'unknown') || '/' || (doc_id // 1024) || '/' || doc_id || '.txt' END AS path FROM documents),
    cut AS (SELECT doc_id, 'h' AS kind, list_filter(string_split_regex(text, '{SPLIT}'), lambda s: regexp_matches(s, '{CUE}')) AS hs FROM rows_ WHERE regexp_matches(text, '{CUE}')
            UNION ALL SELECT doc_id, 'f', list_concat([text], string_split_regex(text, '{PARAGRAPH}')) FROM rows_ WHERE text IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}')),
    headers AS (SELECT doc_id, kind, unnest(hs) AS h, generate_subscripts(hs, 1) AS pos FROM cut),
    own AS (SELECT doc_id, kind, pos, unnest(regexp_extract_all(lower(h), '{WORD}', 0)) AS term FROM headers),
    known AS (SELECT t, kind, lic, unnest(regexp_extract_all(lower(txt), '{WORD}', 0)) AS term FROM templates),
    df AS (SELECT term, count(DISTINCT (doc_id, kind, pos)) AS df FROM own GROUP BY term),
    idf AS (SELECT coalesce(df.term, v.term) AS term, ln(1.0 + ((SELECT count(*) FROM headers) + {len(given)})::DOUBLE / (1 + coalesce(df, 0))) AS idf FROM df FULL JOIN (SELECT DISTINCT term FROM known) v ON df.term = v.term),
    a AS (SELECT doc_id, kind, pos, term, count(*) * any_value(idf) AS w FROM own JOIN idf USING (term) GROUP BY ALL),
    an AS (SELECT doc_id, kind, pos, sqrt(sum(w * w)) AS norm FROM a GROUP BY ALL),
    b AS (SELECT t, kind, lic, term, count(*) * any_value(idf) AS w FROM known JOIN idf USING (term) GROUP BY ALL),
    bn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM b GROUP BY ALL),
    cosines AS (SELECT a.doc_id, a.kind, a.pos, b.t, b.lic, round(sum(a.w / an.norm * b.w / bn.norm), 4) AS cos FROM a JOIN an USING (doc_id, kind, pos) JOIN b USING (kind, term) JOIN bn USING (t) GROUP BY ALL),
    best AS (SELECT doc_id, lic, cos FROM cosines WHERE cos >= {MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, t) = 1),
    placed AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lic, cos FROM rows_ LEFT JOIN best USING (doc_id)),
    granted AS (SELECT folder, lic, cos, doc_id AS origin FROM placed WHERE lic IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}') QUALIFY row_number() OVER (PARTITION BY folder ORDER BY cos DESC, doc_id) = 1),
    nearest AS (SELECT p.folder, g.lic, g.cos, g.origin FROM (SELECT DISTINCT folder FROM placed) p JOIN granted g ON p.folder = g.folder OR starts_with(p.folder, g.folder || '/') QUALIFY row_number() OVER (PARTITION BY p.folder ORDER BY length(g.folder) DESC) = 1)
    SELECT doc_id, coalesce(p.lic, n.lic) AS license, CASE WHEN p.lic IS NOT NULL THEN p.cos ELSE n.cos END AS cosine,
           CASE WHEN p.lic IS NOT NULL THEN 'header' WHEN n.lic IS NOT NULL THEN 'directory' ELSE 'none' END AS via,
           CASE WHEN p.lic IS NOT NULL THEN doc_id ELSE n.origin END AS origin_id
    FROM placed p LEFT JOIN nearest n USING (folder)"""
