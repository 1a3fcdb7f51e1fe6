"""Licences by canonical digest: whole texts and notice lines looked up in a table of known ones. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.shared import attach, cut

#: Known licence texts and notices; fixed values.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT0 = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_MIT}\n{_WARRANTY}"),
    ("MIT", f"MIT License\n{_MIT}\n{_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}\n{_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("0BSD", f"Zero-Clause BSD\n{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD}\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n{_MIT0}\n{_WARRANTY}"),
    ("MIT-0", f"{_MIT0}\n{_WARRANTY}"),
    ("Zlib", f"zlib License\n{_ZLIB}"),
    ("Zlib", _ZLIB),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n{_BOOST}"),
    ("BSL-1.0", _BOOST),
    ("Unlicense", f"{_UNLICENSE}\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", f"{_UNLICENSE}\nFor more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Names of licences in notices; fixed values.
NAMES: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("0BSD", "Zero-Clause BSD License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License v3.0"),
    ("Unlicense", "Unlicense"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0"),
)
#: How notices name a licence; each name has each of them, and an identifier line of its own.
NOTICES = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the {}.", "This software is licensed under the {}.", "This program is licensed under the {}.", "This file is licensed under the {}.")
#: Digests of whole texts that are too long to be held here (with and without what follows the terms), as published; fixed values.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Artistic-1.0-Perl", "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
)
#: Equivalent spellings, words by words, after case and punctuation; fixed values.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licencee", "licensee"), ("licencees", "licensees"), ("licencor", "licensor"), ("licencors", "licensors"), ("sublicence", "sublicense"), ("sublicences", "sublicenses"), ("sublicenced", "sublicensed"), ("sublicencing", "sublicensing"), ("sublicencee", "sublicensee"), ("sublicencees", "sublicensees"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"), ("v 2", "version 2"), ("v2", "version 2"), ("v 3", "version 3"), ("v3", "version 3"))


#: A line that is a copyright mark with a year, sign, name or blank to be filled in, up to its end or to a sentence that goes on about the licence.
COPYRIGHT = (
    r"^[^\p{L}\p{N}\n(©]*(?:(?i:copyright)[ \t:]*(?:\((?i:c)\)|©|[0-9<\[{]|(?i:by) |[A-Z][a-z])|\((?i:c)\)[ \t]*(?:(?i:copyright)|[0-9<\[{])|©)"
    r"[^\n]*?(?:$|\. +((?i:licensed|released|distributed|permission|redistribution|this|dedicated|spdx)\b))"
)
RIGHTS = r"^[^\p{L}\p{N}\n]*(?i:all rights reserved)[^\p{L}\p{N}\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, every run of signs one space, equivalent spellings made one."""
    out = F.regexp_replace(text, f"(?dm){COPYRIGHT}", " $1")
    out = F.lower(F.regexp_replace(out, f"(?dm){RIGHTS}", " "))
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for said, meant in SPELLINGS:
        out = F.replace(out, F.lit(f" {said} "), F.lit(f" {meant} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def notices() -> list[tuple[str, str]]:
    """(license, line) of the lines that name a licence."""
    lines = [(license, form.format(name)) for license, name in NAMES for form in NOTICES]
    return lines + [(license, f"SPDX-License-Identifier: {license}") for license in dict(NAMES)]


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license) of known texts, notices and digests; a digest that two licences share goes to the first by name."""
    rows = spark.createDataFrame([*texts, *notices()], "license string, body string").select(F.sha2(canonical(F.col("body")).cast("binary"), 256).alias("digest"), "license")
    listed = spark.createDataFrame([(digest, license) for license, digest in digests], "digest string, license string")
    return rows.union(listed).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, n_notices, notices) per row of ``docs``.

    digest is that of the whole canonical text (null text: null), license the known licence it is, or null. Lines that speak of
    licences are looked up in the same way: n_notices counts those found and notices lists their licences, distinct, sorted, comma-joined.
    A line or text that is but a copyright line has an empty canonical form, which is no licence. Rows with equal texts get equal
    results, repeated rows each; texts of any length are read whole; an empty table gives none. Other columns are ignored.
    """
    table = cut((known(docs.sparkSession) if table is None else table).where("digest is not null").dropDuplicates(["digest"]))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?i)licen[cs]e|cc0|mozilla public"))
    digests = F.transform(lines, lambda x: F.sha2(canonical(x).cast("binary"), 256))
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), F.xxhash64("text").alias("k1"), F.when(F.col("text").rlike(r"(?i)licen[cs]e|cc0|mozilla public"), digests).alias("lines"))
    rows = cut(rows)
    spread = rows.select("digest", "k1", F.explode("lines").alias("line"))
    found = attach(spread, table.withColumnRenamed("digest", "line"), ["line"], "inner")
    # rows with one text find the same lines; dividing by their number is exact
    copies = rows.where("size(lines) > 0").groupBy("digest", "k1").agg(F.count("*").alias("rows"))
    notices = found.groupBy("digest", "k1").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("license")).alias("notices")).join(copies, ["digest", "k1"])
    notices = cut(notices.select("digest", "k1", (F.col("n") / F.col("rows")).cast("long").alias("n_notices"), F.array_join("notices", ",").alias("notices")))
    out = attach(rows.select("doc_id", "digest", "k1"), table, ["digest"], "left")
    out = attach(out, notices, ["digest", "k1"], "left")
    return out.select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
