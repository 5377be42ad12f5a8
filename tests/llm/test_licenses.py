"""Whole licence texts and notices, wrapped at several columns and within comments: one right licence each."""

import textwrap

import pytest
from pyspark.sql import functions as F

from quillon.llm import licenses

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_LIABLE = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = ["Copyright (c) 2020, A. Person\nAll rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"]
_BSD_ITEMS = [
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_NEITHER = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(what, name, version):
    return [
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.",
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
    ]


TEXTS = {
    "MIT": ["MIT License", "Copyright (c) 2020 A. Person", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", f"{_NO_WARRANTY} {_LIABLE}"],
    "BSD-2-Clause": [*_BSD_HEAD, *_BSD_ITEMS, _BSD_END],
    "BSD-3-Clause": ["BSD 3-Clause License", *_BSD_HEAD, *_BSD_ITEMS, _NEITHER, _BSD_END],
    "ISC": ["ISC License", "Copyright 2020 A. Person", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "1. The origin of this software must not be misrepresented."],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", _NO_WARRANTY + " " + _LIABLE],
    "Apache-2.0": ["Copyright 2020 A. Person. All rights reserved.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.'],
    "GPL-3.0": _gnu("program", "General Public License", "3"),
    "GPL-2.0": _gnu("program", "General Public License", "2"),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "AGPL-3.0": _gnu("program", "Affero General Public License", "3"),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Attribution-NonCommercial-NoDerivatives 4.0 International"],
    "CC0-1.0": ["Creative Commons Legal Code", "CC0 1.0 Universal"],
}
FORMS = {
    "wide": lambda lines: "\n".join(lines),
    "hash": lambda lines: "\n".join(f"# {x}".rstrip() for x in lines),
    "slashes": lambda lines: "import x\n\n" + "\n".join(f"// {x}".rstrip() for x in lines) + "\n\ncode();",
    "star": lambda lines: "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */",
}


@pytest.mark.parametrize("width", [60, 72, 78, 10_000])
def test_whole_texts_give_one_licence(spark, width):
    rows = []
    for name, parts in TEXTS.items():
        lines = []
        for part in parts:
            for line in part.split("\n"):
                lines += textwrap.wrap(line, width, break_on_hyphens=False)
            lines.append("")
        rows += [(name, form, make(lines)) for form, make in FORMS.items()]
    got = licenses.scan_documents(spark.createDataFrame(rows, "name string, form string, text string")).select("name", "form", "license.detected").collect()
    assert len(got) == len(rows) and {(r.name, r.form): r.detected for r in got} == {(n, f): n for n, f, _ in rows}


def test_tags_mentions_and_several_licences(spark):
    texts = {
        "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": "GPL-2.0",
        "# SPDX-License-Identifier: CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0",
        "Released under the MIT License.\n\nThis work is licensed under the GNU General Public License version 3.": "MIT;GPL-3.0",
        "All rights reserved.": "Proprietary",
        "All rights reserved.\nReleased under the MIT License.": "MIT",
        "We like the MIT License and others.": "",
        "": "",
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, text string").withColumn("license", F.lit("x"))
    got = {r.i: r["license"].detected for r in licenses.scan_documents(frame).collect()}
    assert got == {**dict(enumerate(texts.values())), 99: ""}


def test_very_long_texts_and_repeated_rows(spark):
    long = "a b c. " * 200_000 + "\n\n" + "\n".join(textwrap.wrap(TEXTS["BSD-3-Clause"][1], 70)) + "\n\n" + "\n\n".join(TEXTS["BSD-3-Clause"][2:])
    rows = [(1, long), (1, long), (2, "MIT License"), (2, "MIT License")]
    got = licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license.detected", "license.n_sentences").collect()
    assert sorted((r.doc_id, r.detected) for r in got) == [(1, "BSD-3-Clause")] * 2 + [(2, "MIT")] * 2
    assert all(r.n_sentences > 200_000 for r in got if r.doc_id == 1)
