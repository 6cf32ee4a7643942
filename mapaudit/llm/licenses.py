"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised (lower case, letters and digits only, single spaces) and
looked up among known licence sentences. The identifiers found, in order, are matched against ordered
rules: the first rule whose sequence occurs takes its identifiers, and the later ones get what is left.
All of it is column expressions on single rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


# Public licence sentences by identifier, and the rules over them, first to last.
SENTENCES: dict[str, list[str]] = {
    "apache-2": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")",
                 "SPDX-License-Identifier: Apache-2.0", "This work is licensed under the Apache License, Version 2.0"],
    "apache-may": ["You may not use this file except in compliance with the License",
                   "you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                    "You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License",
            "SPDX-License-Identifier: MIT", "The MIT License", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                  "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                  "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                  "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
                  "shall be included in all copies or substantial portions of the Software"],
    "mit-grant-head": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                       "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
                       "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
                       "persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-grant-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                  "provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                           "following conditions are met",
                           "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                           "following conditions are met: 1"],  # the number of the first clause
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                   "disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                 "derived from this software without specific prior written permission"],
    "bsd-2": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License"],
    "bsd-3": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License"],
    "gpl-2": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2",
              "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3",
              "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-3-later": ["SPDX-License-Identifier: GPL-3.0-or-later",
                    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-notice": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                   "Foundation"],
    "lgpl-notice": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
                    "Software Foundation"],
    "later-2": ["either version 2 of the License, or (at your option) any later version"],
    "later-21": ["either version 2.1 of the License, or (at your option) any later version"],
    "later-3": ["either version 3 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                     "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
                     "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl-21": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl-3": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "cc-by-nd-4": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "cc-0": ["SPDX-License-Identifier: CC0-1.0", "Released under CC0 1.0", "This work is dedicated to the public domain"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}


@dataclass(frozen=True)
class Rule:
    licence: str
    sequence: tuple[str, ...]


RULES = (
    Rule("Apache-2.0", ("apache-2", "apache-may", "apache-copy", "apache-as-is", "apache-see")),
    Rule("Apache-2.0", ("apache-2", "apache-may")),
    Rule("Apache-2.0", ("apache-2",)),
    Rule("MIT", ("mit", "mit-grant")),
    Rule("MIT", ("mit-grant",)),
    Rule("MIT", ("mit", "mit-grant-head", "mit-grant-notice")),
    Rule("MIT", ("mit-grant-head", "mit-grant-notice")),
    Rule("MIT", ("mit",)),
    Rule("ISC", ("isc-grant",)),
    Rule("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    Rule("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    Rule("BSD-2-Clause", ("bsd-2",)),
    Rule("BSD-3-Clause", ("bsd-3",)),
    Rule("GPL-3.0-or-later", ("gpl-3-later", "gpl-warranty")),
    Rule("GPL-3.0-or-later", ("gpl-3-later",)),
    Rule("GPL-3.0-or-later", ("gpl-notice", "later-3")),
    Rule("GPL-2.0-or-later", ("gpl-notice", "later-2")),
    Rule("LGPL-3.0-or-later", ("lgpl-notice", "later-3")),
    Rule("LGPL-2.1-or-later", ("lgpl-notice", "later-21")),
    Rule("GPL-3.0", ("gpl-3", "gpl-warranty")),
    Rule("GPL-3.0", ("gpl-3",)),
    Rule("GPL-2.0", ("gpl-2", "gpl-warranty")),
    Rule("GPL-2.0", ("gpl-2",)),
    Rule("LGPL-2.1", ("lgpl-21",)),
    Rule("AGPL-3.0", ("agpl-3",)),
    Rule("MPL-2.0", ("mpl-2",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    Rule("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    Rule("CC-BY-4.0", ("cc-by-4",)),
    Rule("CC0-1.0", ("cc-0",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("All-rights-reserved", ("reserved",)),
)

#: A sentence is looked up only if it has one of these; every known sentence has.
HINT = "licen[cs]|spdx|copyright|permission|redistribution|rights reserved|warrant|public domain|cc0|file except"
KNOWN = {normal(s): key for key, sentences in SENTENCES.items() for s in sentences}
assert all(re.search(HINT, s) for s in KNOWN)

#: Where a sentence ends: after . ! ? ; before white space, and at a line feed before a capital or a mark.
BREAKS = (("([.!?;])\\s+", 1), ("\\s*\\n\\s*([A-Z#*/\"-])", 2))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order; ``unknown`` for a sentence that names a
    licence (it has the word "licensed") but is none of the known ones."""
    marked = F.regexp_replace(F.regexp_replace(text, BREAKS[0][0], "$1\u0001"), BREAKS[1][0], "\u0001$1")
    parts = F.filter(F.split(marked, "\u0001"), lambda s: F.lower(s).rlike(HINT))
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    table = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    ids = F.transform(plain, lambda s: F.coalesce(table[s], F.when(s.rlike("(^| )licen[cs]ed( |$)"), F.lit(UNKNOWN))))
    return F.filter(ids, lambda s: s.isNotNull())


def licences(docs: DataFrame) -> DataFrame:
    """``doc_id, sentences, licenses, n_unknown`` of every row.

    sentences: identifiers in order, comma-joined. licenses: those of the rules that matched, in the order
    of the rules, each once. n_unknown: sentences that name a licence not known here. Null and empty texts
    have none of them. Rows are taken one by one, so repeated rows and null ids stay.
    """
    rows = docs.select("doc_id", F.coalesce(sentence_ids(F.coalesce("text", F.lit(""))), F.array().cast("array<string>")).alias("ids"))
    # ,a,b, holds every sequence between commas; a rule turns its own into a bar.
    rows = rows.select("doc_id", "ids", F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("left"))
    return _apply_rules(rows)


def _apply_rules(rows: DataFrame) -> DataFrame:
    """Rule after rule on what the ones before have left; a fold over the rule table inside the row."""
    rules = F.array(*(F.struct(F.lit("," + ",,".join(r.sequence) + ",").alias("sequence"), F.lit(r.licence).alias("licence")) for r in RULES))
    begin = F.struct(F.col("left").alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state, rule):
        hit = F.contains(state["left"], rule["sequence"])
        return F.struct(F.replace(state["left"], rule["sequence"], F.lit("|")).alias("left"),
                        F.when(hit, F.array_append(state["found"], rule["licence"])).otherwise(state["found"]).alias("found"))

    found = F.when(F.size("ids") > 0, F.aggregate(rules, begin, step)["found"]).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.array_join("ids", ",").alias("sentences"), F.array_join(F.array_distinct(found), ",").alias("licenses"),
                       F.size(F.filter("ids", lambda s: s == UNKNOWN)).cast("long").alias("n_unknown"))
