"""License scans by canonical digest.

A text is normalised (case, punctuation, white space, copyright statements, list markers, equivalent
spellings) and the digest of all that remains is looked up among the digests of known licences by a hash join.
Licences that are short are kept as texts, with the titles they come under; of long ones only the
digests are kept, of the whole text and of its terms alone. Short notices are whole lines: each line
that could be one is normalised and looked up in the same way, so a notice inside a longer
document is found too. The pack of known texts is a list: its size is checked before it is broadcast.

A copyright statement is a line that begins with "copyright" and goes on with (c), a year or a placeholder,
or begins with (c) and a year; a line that is only "all rights reserved" goes with it. A statement with
a bare name is part of the text, since it can't be told from a sentence's continuation.

Defined results: null counts as empty; a text with nothing left after normalising has a digest
and matches no licence; repeated rows repeat their result; equal notices in one document count
each time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import ascii_lower, table, without

OUTPUTS = ("text_sha256", "license", "notices", "n_notices")
#: A pack of more texts than this isn't broadcast, and isn't accepted as notices.
MOST_KNOWN = 100_000

#: After lower-casing, in lines that end with \n alone: copyright statements and list markers.
LINE_PARTS = (
    r"^[^\na-z0-9]*(?:portions[\x20\t]+)?copyright[\x20\t:]*(?:\(c\)|\xA9|[0-9<\[{])[^\n]*$"
    r"|^[^\na-z0-9]*(?:\(c\)|\xA9)[\x20\t]*[0-9][^\n]*$"
    r"|^[^\na-z0-9]*all[\x20\t]+rights[\x20\t]+reserved[^\na-z0-9]*$"
    r"|^[^\na-z0-9]*(?:[0-9]{1,2}|[a-z])[.)][\x20\t]"
)
#: In Java only the d flag makes \n the one line end.
DROPPED, DROPPED_JAVA = f"(?m){LINE_PARTS}", f"(?md){LINE_PARTS}"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Equivalent spellings of a word, after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("https", "http"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)

# Whole licences.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public
at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of
the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part,
and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
}
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"
_THIRD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
LICENSES["BSD-3-Clause"] = LICENSES["BSD-2-Clause"].replace(_DISCLAIMER, _THIRD_CLAUSE + _DISCLAIMER)
# Wordings that these texts also come in.
WORDINGS = (("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"),)

# Titles that these texts come under.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0"),
}

# Digests of long licences after normalising: the whole published text, and its
# terms without the appendix that tells how to apply them.
DIGESTS = {
    "f86c45fc72b043272de5d765793567a95363a0016be29aaee3c6a6d8b0ca5532": "Apache-2.0",
    "9666d051921bc497595d01b3c5b73b1f06842a6aa072b0221619c1e6d78d99e7": "Apache-2.0",
    "95ebafaabf80c10ce0c02d6506b3c942348da0561e2d2af910f930ef055bc343": "Apache-2.0",
    "d12bf436716562844f9a1fa4b2d7f3d40b9a3958451bc802147a9b1f72b26449": "GPL-1.0",
    "d7aceb17a2c2dd23444118f2a4f564bc44b82289e8c3d716e2a0aa51477e2a60": "GPL-1.0",
    "4452769e29101352853bc9d93adbe36b35f6c06a1187c50908a84195a54af0fc": "GPL-1.0",
    "5fbaf82c679588b288227e6fa2348731ce4db7888a791bdf8a007da45db6d110": "GPL-2.0",
    "53c45912d872de7563a67955bca147dbe241ad9f7d6b9c6cc1b0428b44382526": "GPL-2.0",
    "8792a083b0fa7b9790a563119427f62f124a7ab2756e92e1d4128f349637fb89": "GPL-2.0",
    "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64": "GPL-3.0",
    "a7d16b580457c566303df373fd362c5bfbfbc013734bed4e4cf732a569a5598e": "GPL-3.0",
    "8c24ccf35998bd73317aa0801f6e6cbd865514baf55f246a48a8e890d1abc3d1": "GPL-3.0",
    "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2": "LGPL-2.0",
    "9445838f80c534db1f71155f4c93f1464bf680d2a091792f3f2146f5cefef806": "LGPL-2.0",
    "2894b2cb46a2c83844eec54a57337498c55bc0779fe2dbdd14bc94a567a3c32e": "LGPL-2.0",
    "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98": "LGPL-2.1",
    "70a277553f5f0e974016dfc6aed9adda07c554792c5f1f3d75acb63053de3f89": "LGPL-2.1",
    "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3": "LGPL-2.1",
    "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45": "LGPL-3.0",
    "661007e231ca5b302d4c3ee263967beb6a810bf9cb12a246d2d15ac0c31860b5": "MPL-1.1",
    "8dce888cb942d93cebeb8e0fea8afac43e084f54254ac4d9b99cfde68a62468b": "MPL-2.0",
    "51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa": "CC0-1.0",
    "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49": "Artistic-1.0",
    "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d": "GFDL-1.2",
    "3e03599855be6f5154c1bba1c4189768a3518f5863527559438fa78fa2262af5": "GFDL-1.3",
}

# One-line notices.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under the GNU General Public License v3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
}
#: A line is normalised only if it holds one of these; every notice above does.
NOTICE_HINT = r"(?i)licen[sc]|spdx"


def canonical(text: Column) -> Column:
    """Lower case, no copyright statements, words apart by one space, one spelling.

    Words stand two blanks apart while spellings are replaced, so that neighbours don't share one.
    """
    bare = F.regexp_replace(ascii_lower(text), DROPPED_JAVA, " ")
    words = F.concat(F.lit(" "), F.regexp_replace(bare, NOT_WORD, "  "), F.lit(" "))
    for one, other in SPELLINGS:
        words = F.replace(words, F.lit(f" {one} "), F.lit(f" {other} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def canonical_text(text: str) -> str:
    """The same for one string, word by word: digests of the known texts are made with it."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    spelling = dict(SPELLINGS)
    return " ".join(spelling.get(w, w) for w in re.split(NOT_WORD, re.sub(DROPPED, " ", lower)) if w)


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known(texts: dict[str, str]) -> dict[str, str]:
    """Digest to licence, for a dict of text to licence."""
    return {digest_of(text): name for text, name in texts.items()}


def known_licenses(licenses: dict[str, str] = LICENSES, titles: dict[str, tuple[str, ...]] = TITLES) -> dict[str, str]:
    """Digest to licence of whole texts, bare and under each of their titles."""
    texts = {}
    for name, body in licenses.items():
        for wording in (body, *(body.replace(*pair) for pair in WORDINGS)):
            texts |= {f"{title}\n\n{wording}": name for title in titles.get(name, ())}
            texts[wording] = name
    return known(texts)


def scanned(
    docs: DataFrame,
    licenses: dict[str, str] = known_licenses() | DIGESTS,
    notices: dict[str, str] = NOTICES,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with text_sha256, license (of the entire text), notices and n_notices.

    ``licenses`` maps digests of whole texts to names, ``notices`` lines to names; a notice may be a
    whole text too. Digests of notices are a literal that each line is compared with, since a join by
    line would shuffle documents.
    """
    spark = docs.sparkSession
    if len(notices) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} notices")
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_digest = known(notices)
    whole = by_digest | licenses
    listed = spark.createDataFrame(sorted(whole.items()), "__cw_digest string, license string")
    listed = F.broadcast(listed) if len(whole) <= MOST_KNOWN else listed
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(NOTICE_HINT)))
    by_line = F.create_map(*[F.lit(x) for pair in sorted(by_digest.items()) for x in pair]) if by_digest else F.create_map().cast("map<string,string>")
    found = F.transform(lines, lambda line: F.try_element_at(by_line, F.sha2(canonical(line), 256)))
    rows = without(docs, *OUTPUTS).withColumns(
        {"text_sha256": F.sha2(canonical(text), 256), "__cw_notices": F.filter(found, lambda x: x.isNotNull())}
    )
    matched = rows.join(listed, F.col("text_sha256") == F.col("__cw_digest"), "left")
    return matched.withColumns(
        {
            "notices": F.array_join(F.array_sort(F.array_distinct("__cw_notices")), ","),
            "n_notices": F.size("__cw_notices").cast("bigint"),
        }
    ).drop("__cw_digest", "__cw_notices")


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scanned(docs).select("doc_id", *OUTPUTS)
