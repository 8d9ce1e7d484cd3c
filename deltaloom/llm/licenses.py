"""License scans (native): canonical digest lookup of entire texts.

A text is put in canonical form (case, copyright lines, punctuation, equivalent
spellings) and its SHA-256 is hash-joined to the digests of known licences, put
in the same form by the same code. Licences are known by their text, with and
without a title line, or by the digest of their canonical form. The lines of a text
that speak of a licence are looked up in the same way, so that a notice is found
wherever it is a line of its own.

Defined results: null text has a null digest, no licence and no notices; texts that
are empty in canonical form match nothing; two known licences with one digest (ties):
the first id; each of several equal rows has its result; texts of any length are
digested whole; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence texts use for the same word, as (written, canonical).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Texts of public licences, and notices that stand for a licence.
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n" + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n" + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n" + _AS_IS,
    "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
    "law.\n" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + "\nFor more information, please refer to <https://unlicense.org/>",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:MIT": "Released under the MIT License.",
}


# Title lines that precede these texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

# SHA-256 of the canonical form of longer licences, as published by their stewards.
DIGESTS = {
    "Apache-2.0": "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "BSD-3-Clause-Regents": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "890d36e662cb09f33113b55d7d1c753ddc4b0ead994791dfdbdaf4349bb51e36",
    "GFDL-1.3": "ade5f7440f9cc494ee9b2d9d76ef9d5e7528b55ddcc78de4bc94bea8a66d4e50",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-3.0": "9c475ed1e924fe0f0e64bc816060f8b770d72c9093b2024c63032292abaecc2d",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}

#: Every line that is a notice has this, in lower case.
NOTICE_MARK = "licen"
#: A line that begins with the word or the sign and has a year or the sign after it, or the start of one that reserves all rights.
_COPYRIGHT = r"[^\p{L}\p{N}\n]*(?:(?:\(c\)|copyright|©)[^\n]*(?:[0-9]{4}|\(c\)|©)[^\n]*|all rights reserved)"


def canonical(text: Column) -> Column:
    t = F.lower(text)
    t = F.regexp_replace(t, rf"(^|\n){_COPYRIGHT}", "$1")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    for written, meant in SPELLINGS:  # from where a word begins, so that its other forms are covered
        t = F.replace(t, F.lit(f" {written}"), F.lit(f" {meant}"))
    return F.trim(t)


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    t = rf"regexp_replace(lower({text}), '(^|\n){_COPYRIGHT}', '\1', 'g')"
    t = rf"' ' || regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    for written, meant in SPELLINGS:
        t = f"replace({t}, ' {written}', ' {meant}')"
    return f"trim({t})"


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) with and without titles."""
    return [(k, f"{title}\n{v}" if title else v) for k, v in KNOWN.items() for title in ("", *TITLES.get(k, ()))]


def digests_of(texts: DataFrame) -> DataFrame:
    """(license_id, text) to license_id, digest."""
    return texts.select("license_id", canonical(F.col("text")).alias("c")).where("c != ''").select("license_id", F.sha2("c", 256).alias("digest"))


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """license_id and digest of a folder that holds one licence a file, named by its id."""
    texts = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("license_id"), F.col("value").alias("text"))
    return digests_of(texts)


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id and digest; some dozens of rows, known here."""
    explode = lambda pairs, name: spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(v).alias(name)) for k, v in pairs))).alias("p")).select("p.*")
    return digests_of(explode(known_texts(), "text")).union(explode(DIGESTS.items(), "digest"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (null: none), notices for each row of docs (doc_id, text); known: (license_id, digest).

    notices lists the ids of the known texts that are lines of the text, sorted and joined by commas.
    """
    digests = known.where("digest is not null").groupBy(F.col("digest").alias("known")).agg(F.min("license_id").alias("license_id"))
    # the catalogue is small and known to the driver: lines are looked up in it as a literal, where they are
    entries = [F.lit(x) for r in digests.orderBy("known").collect() for x in r]
    ids = F.create_map(*entries) if entries else F.create_map(F.lit(""), F.lit(""))
    c = canonical(F.col("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.lower(line).contains(NOTICE_MARK))
    found = F.array_distinct(F.filter(F.transform(lines, lambda line: F.try_element_at(ids, F.sha2(canonical(line), 256))), lambda x: x.isNotNull()))
    notices = F.when(F.lower("text").contains(NOTICE_MARK), F.array_join(F.array_sort(found), ",")).otherwise("")
    found = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.sha2(c, 256)).alias("digest"), notices.alias("notices"))
    return found.join(digests, F.col("digest") == F.col("known"), "left").select("doc_id", "digest", "license_id", "notices")
