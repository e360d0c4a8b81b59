"""License scans by sentence rules, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline.llm.arrow import lower_ascii

# The parts of licence names that end in "4.0 International".
CREATIVE = {"by": "attribution", "by_sa": "attribution sharealike", "by_nd": "attribution noderivatives", "by_nc": "attribution noncommercial", "by_nc_sa": "attribution noncommercial sharealike", "by_nc_nd": "attribution noncommercial noderivatives"}
# Identifiers of known licence sentences, normalised (a-z and 0-9, single spaces).
SENTENCES = {
    "mit_ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache_ref": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache_comply": ["you may not use this file except in compliance with the license"],
    "apache_basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", *[f"you may obtain a copy of the license at {x} www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied" for x in ("http", "https")]],
    "gpl3_ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl_later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl_warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc_by_nc_ref": ["licensed under cc by nc 4 0"],
    "cc_by_ref": ["licensed under cc by 4 0"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mit_0_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"],
    "apache_title": ["apache license"],
    "apache_date": ["version 2 0 january 2004"],
    "gpl_title": ["gnu general public license"],
    "lgpl_title": ["gnu lesser general public license"],
    "library_title": ["gnu library general public license"],
    "agpl_title": ["gnu affero general public license"],
    "fdl_title": ["gnu free documentation license"],
    "gpl_1_date": ["version 1 february 1989"],
    "gpl_2_date": ["version 2 june 1991"],
    "lgpl_2_1_date": ["version 2 1 february 1999"],
    "gpl_3_date": ["version 3 29 june 2007"],
    "agpl_3_date": ["version 3 19 november 2007"],
    "fdl_1_3_date": ["version 1 3 3 november 2008"],
    "gpl_2_later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl_2_only": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "lgpl_2_1_later": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl_3_later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl_3_later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "bsd_advertising": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd_clear": ["no express or implied licenses to any party s patent rights are granted by this license"],
    "isc_grant": [f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("and or", "and")],
    "isc_warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "zero_bsd_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib_warranty": ["this software is provided as is without any express or implied warranty"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost_title": ["boost software license version 1 0 august 17th 2003"],
    "unlicense_release": ["this is free and unencumbered software released into the public domain"],
    "wtfpl_title": ["do what the fuck you want to public license"],
    "mpl_1_1_title": ["mozilla public license version 1 1"],
    "mpl_2_title": ["mozilla public license version 2 0"],
    "mpl_2_notice": ["this source code form is subject to the terms of the mozilla public license v"],
    "epl_1_title": ["eclipse public license v 1 0"],
    "epl_2_title": ["eclipse public license v 2 0"],
    "cddl_title": ["common development and distribution license cddl version 1 0"],
    "artistic_1_title": ["the artistic license"],
    "artistic_2_title": ["the artistic license 2 0", "artistic license 2 0"],
    "ofl_title": ["sil open font license version 1 1 26 february 2007"],
    "ofl_notice": ["this font software is licensed under the sil open font license version 1 1"],
    "postgresql_grant": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "psf_title": ["python software foundation license version 2"],
    "ncsa_title": ["university of illinois ncsa open source license"],
    "ms_pl_title": ["microsoft public license ms pl"],
    "cc0_title": ["cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"],
    **{f"cc_{key}": [f"this work is licensed under a creative commons {name} 4 0 international license", f"this work is licensed under the creative commons {name} 4 0 international license", f"licensed under cc {key.replace('_', ' ')} 4 0", f"{name} 4 0 international"] for key, name in CREATIVE.items() if key != "by_nc" and key != "by"},
    "reserved": ["all rights reserved"],
}
SENTENCES["cc_by_ref"] += ["this work is licensed under a creative commons attribution 4 0 international license", "attribution 4 0 international"]
SENTENCES["cc_by_nc_ref"] += ["this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0 international"]
# Ordered rules, each a licence and the identifiers that must follow one another among a text's known sentences. Whole texts come first, as some end with a notice to copy.
RULES = [
    ("Apache-2.0", ["apache_title", "apache_date"]),
    ("AGPL-3.0", ["agpl_title", "agpl_3_date"]),
    ("LGPL-3.0", ["lgpl_title", "gpl_3_date"]),
    ("LGPL-2.1", ["lgpl_title", "lgpl_2_1_date"]),
    ("LGPL-2.0", ["library_title", "gpl_2_date"]),
    ("GPL-3.0", ["gpl_title", "gpl_3_date"]),
    ("GPL-2.0", ["gpl_title", "gpl_2_date"]),
    ("GPL-1.0", ["gpl_title", "gpl_1_date"]),
    ("GFDL-1.3", ["fdl_title", "fdl_1_3_date"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("Apache-2.0", ["apache_ref", "apache_comply", "apache_basis"]),
    ("AGPL-3.0-or-later", ["agpl_3_later", "gpl_warranty"]),
    ("LGPL-3.0-or-later", ["lgpl_3_later"]),
    ("LGPL-2.1-or-later", ["lgpl_2_1_later"]),
    ("GPL-3.0-or-later", ["gpl_later", "gpl_warranty"]),
    ("GPL-2.0-or-later", ["gpl_2_later", "gpl_warranty"]),
    ("GPL-2.0-only", ["gpl_2_only"]),
    ("BSD-3-Clause-Clear", ["bsd_endorse", "bsd_clear"]),
    ("BSD-4-Clause", ["bsd_source", "bsd_binary", "bsd_advertising"]),
    ("BSD-3-Clause", ["bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_source", "bsd_binary"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("0BSD", ["zero_bsd_grant", "isc_warranty"]),
    ("Zlib", ["zlib_warranty", "zlib_grant"]),
    ("MIT-0", ["mit_0_grant", "as_is"]),
    ("MPL-2.0", ["mpl_2_title"]),
    ("MPL-2.0", ["mpl_2_notice"]),
    ("MPL-1.1", ["mpl_1_1_title"]),
    ("EPL-2.0", ["epl_2_title"]),
    ("EPL-1.0", ["epl_1_title"]),
    ("CDDL-1.0", ["cddl_title"]),
    ("BSL-1.0", ["boost_title"]),
    ("Unlicense", ["unlicense_release"]),
    ("WTFPL", ["wtfpl_title"]),
    ("Artistic-2.0", ["artistic_2_title"]),
    ("Artistic-1.0", ["artistic_1_title"]),
    ("OFL-1.1", ["ofl_notice"]),
    ("OFL-1.1", ["ofl_title"]),
    ("PostgreSQL", ["postgresql_grant"]),
    ("PSF-2.0", ["psf_title"]),
    ("NCSA", ["ncsa_title"]),
    ("MS-PL", ["ms_pl_title"]),
    ("CC0-1.0", ["cc0_title"]),
    ("MIT", ["mit_grant"]),
    ("ISC", ["isc_grant"]),
    ("Apache-2.0", ["apache_ref"]),
    ("MIT", ["mit_ref"]),
    ("GPL-3.0-only", ["gpl3_ref"]),
    *[(f"CC-{key.upper().replace('_', '-')}-4.0", [f"cc_{key}"]) for key in CREATIVE if key not in ("by", "by_nc")],
    ("CC-BY-NC-4.0", ["cc_by_nc_ref"]),
    ("CC-BY-4.0", ["cc_by_ref"]),
    ("LicenseRef-reserved", ["reserved"]),
]
# A tag names a licence by its identifier: a sentence and a rule for each identifier above.
TAGGED = [x for x in dict.fromkeys(name for name, _ in RULES) if not x.startswith("LicenseRef")]
_tag = lambda x: "spdx_" + x.lower().replace("-", "_").replace(".", "_")
SENTENCES |= {_tag(x): ["spdx license identifier " + x.lower().replace("-", " ").replace(".", " ")] for x in TAGGED}
RULES = [*RULES[:-1], *[(x, [_tag(x)]) for x in TAGGED], RULES[-1]]


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None, sentences=None) -> DataFrame:
    """(id, n_sentences, sentence_ids, licenses, license): a row for each row of docs.

    A sentence ends at a line's end, or at . ! or ? before white space; it is compared in a-z and 0-9 with single
    spaces, whole. Lines up to . ! ?, a line without letters and digits or one of a copyright's year or sign are also
    joined, and compared whole and cut at : and ; too; what names most identifiers counts, the single lines at a tie.
    n_sentences counts single lines. sentence_ids: identifiers of the known ones in order, comma-joined; licenses: every rule's licence
    whose identifiers follow one another there, in rule order, once each; license: the first, else null. Null counts as
    empty and has no sentences. A projection of built-in functions: no shuffle, and its tables are constants.
    """
    rules, sentences = RULES if rules is None else rules, SENTENCES if sentences is None else sentences
    text = F.regexp_replace(lower_ascii(F.coalesce(text_col, F.lit(""))), "(?m)^([^a-z0-9\\n]*copyright (?:\\(c\\)|©|[0-9])[^\\n]*)\\n", "$1\u0001")
    text = F.regexp_replace(text, "([.!?])[ \\t\\n\\r\\f]+", "$1\u0001")
    marked = F.regexp_replace(text, "\\n(?:[^a-z0-9\\n\\x01]*\\n)+", "\u0001")
    ident = F.create_map(*[F.lit(x) for name, texts in sentences.items() for t in texts for x in (t, name)])
    clean = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    known = lambda parts: F.filter(F.transform(parts, lambda s: F.try_element_at(ident, clean(s))), lambda s: s.isNotNull())
    none = F.array().cast("array<string>")
    most = lambda lists: F.reduce(F.array(*lists), none, lambda best, x: F.when(F.size(x) > F.size(best), x).otherwise(best))  # noqa: E731  each list is made once
    ways = lambda s: [known(F.split(s, "\n")), known(F.array(s)), known(F.split(s, "[:;][ \\t\\n\\r\\f]+")), known(F.split(s, "\n|[:;][ \\t\\r\\f]+"))]
    joined = lambda s: F.when(s.rlike("\n|[:;][ \\t\\r\\f]"), most(ways(s))).otherwise(known(F.array(s)))
    normal = F.filter(F.transform(F.split(text, "[\\n\\x01]"), clean), lambda s: s != "")
    named = docs.select(F.col(id_col), F.size(normal).cast("long").alias("n_sentences"), F.flatten(F.transform(F.split(marked, "\\x01"), joined)).alias("ids"))
    chain = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    hits = [F.when(F.contains(chain, F.lit("," + ",".join(seq) + ",")), F.lit(name)) for name, seq in rules]
    found = named.withColumn("hits", F.array_distinct(F.array_compact(F.array(*hits))))
    return found.select(id_col, "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), F.array_join("hits", ",").alias("licenses"), F.try_element_at("hits", F.lit(1)).alias("license"))
