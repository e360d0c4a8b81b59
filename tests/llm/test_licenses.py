import os
import textwrap

from seamline.llm import licenses

MIT = ["MIT License", "Copyright (c) 2020 A. Person", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.']
BSD = ["Copyright (c) 2020, A. Person", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.']
APACHE = ["Copyright 2020 A. Person", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.']
GPL = ["Copyright (C) 2020 A. Person", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."]


def test_whole_licences_in_any_layout(spark):
    rows, want = [], {}
    for name, parts, ids in [("MIT", MIT, "mit_grant,mit_notice,as_is"), ("BSD-3-Clause", BSD, "bsd_source,bsd_binary,bsd_endorse"), ("Apache-2.0", APACHE, "apache_ref,apache_comply,apache_basis"), ("GPL-3.0-or-later", GPL, "gpl_later,gpl_warranty")]:
        wrap = lambda w: ["\n".join(textwrap.wrap(p, w)) for p in parts]
        layouts = ["\n\n".join(parts), "\n".join(parts), "\n\n".join(wrap(78)), "\n\n".join(wrap(50)), parts[0] + "\n" + " ".join(parts[1:]) if name != "MIT" else "\n".join(parts[:2]) + "\n" + " ".join(parts[2:])]
        layouts.append("\n".join(" * " + x for x in layouts[2].split("\n")))
        for t in layouts:
            want[len(rows)] = (name, ids)
            rows.append((len(rows), t))
    got = {r["doc_id"]: (r["license"], r["sentence_ids"]) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (got[i], rows[i][1]) for i in want if got[i] != want[i]} == {}


MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = ["Copyright 2020 A. Person", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.']
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
GPL2 = [GPL[0], GPL[1].replace("version 3", "version 2"), GPL[2]]
FILES = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "GFDL-1.3": "GFDL-1.3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0"}


def test_more_licences(spark):
    whole = [
        ("MPL-2.0", [MPL]), ("ISC", ISC), ("LGPL-2.1-or-later", [LGPL]), ("GPL-2.0-or-later", GPL2), ("BSD-2-Clause", [*BSD[:4], BSD[5]]), ("AGPL-3.0-or-later", [GPL[0], GPL[1].replace("GNU General", "GNU Affero General"), GPL[2]]),
        ("CC-BY-SA-4.0", ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]), ("Unlicense", ["This is free and unencumbered software released into the public domain."]),
        ("Apache-2.0", ["// SPDX-License-Identifier: Apache-2.0", "import x"]), ("MIT", ["# SPDX-License-Identifier: MIT"]), (None, ["The license of this text is not stated anywhere, the software is."]),
    ]
    layouts = [lambda p: "\n\n".join(p), lambda p: "\n\n".join("\n".join(textwrap.wrap(x, 72)) for x in p), lambda p: "\n".join(" * " + y for x in p for y in [*textwrap.wrap(x, 60), ""])]
    rows = [(name, f(parts)) for name, parts in whole for f in layouts]
    for file, name in FILES.items():
        if os.path.exists(f"/usr/share/common-licenses/{file}"):
            with open(f"/usr/share/common-licenses/{file}", encoding="utf-8") as f:
                rows.append((name, f.read()))
    got = {r["doc_id"]: r["license"] for r in licenses.recognise(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert {(i, got[i], name, t[:60]) for i, (name, t) in enumerate(rows) if got[i] != name} == set()


def test_rules_name_known_sentences():
    assert {i for _, seq in licenses.RULES for i in seq} <= set(licenses.SENTENCES) and len({name for name, _ in licenses.RULES}) >= 40
    texts = [t for ts in licenses.SENTENCES.values() for t in ts]
    assert len(texts) == len(set(texts)) and all(t == " ".join(t.split()) and t.replace(" ", "").isalnum() and t == t.lower() for t in texts)
