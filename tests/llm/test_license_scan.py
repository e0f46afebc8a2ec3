import random
import time

import pytest

from quern.llm import license_scan as L
from quern.llm.common import table
from tests.conftest import SF2
from tests.llm.helpers import docs, empty, odd

MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files. The above copyright notice
and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted:
Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice.
Neither the name of X nor the names of its contributors may be used to endorse or promote products.
THIS SOFTWARE IS PROVIDED BY THE AUTHORS "AS IS" AND ANY WARRANTIES ARE DISCLAIMED."""


def licences(text):
    return L.match_rules(L.identify(text))[0]


def test_known_sentences():
    assert licences("words.\nLicensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert licences("Released under the MIT License.") == ["MIT"]
    assert licences("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert licences("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC"]
    assert licences("All rights reserved.") == ["Proprietary"]
    assert licences("# SPDX-License-Identifier: MPL-2.0") == ["mpl-2.0"]
    assert licences("a plain sentence about a license to kill") == []


GNU = """This {what} is free software{sign} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {what}.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_gnu_headers_in_one_sentence():
    for what, sign, kind, comma, version, want in (
        ("program", ":", "", ",", "3", "GPL-3.0-or-later"),
        ("program", ";", "", ";", "2", "GPL-2.0-or-later"),
        ("library", ";", "Lesser ", ";", "2.1", "LGPL-2.1-or-later"),
        ("library", ";", "Library ", ";", "2", "LGPL-2.0-or-later"),
        ("program", ":", "Affero ", ",", "3", "AGPL-3.0-or-later"),
    ):
        text = GNU.format(what=what, sign=sign, kind=kind, comma=comma, version=version)
        assert licences(text) == [want]
        assert licences(text.split("\n\n")[0]) == [want]
        assert licences("\n".join("# " + x for x in text.split("\n"))) == [want]
        assert licences(text.split("\n\n")[2]) == [want.split("-")[0] + ("-3.0" if want[0] == "A" else "")]


def test_every_licence_of_a_sentence():
    assert licences("Dual-licensed under the MIT license and the GNU General Public License, version 2.") == ["MIT", "GPL-2.0"]
    assert licences("Licensed under either of Apache License, Version 2.0 or MIT license at your option.") == ["Apache-2.0", "MIT"]
    assert licences("// SPDX-License-Identifier: MIT OR Apache-2.0") == ["mit", "apache-2.0"]
    assert licences("SPDX-License-Identifier: (MIT AND CC-BY-4.0) OR GPL-2.0-only WITH Classpath-exception-2.0") == [
        "mit", "cc-by-4.0", "gpl-2.0-only with classpath-exception-2.0",
    ]
    assert licences("SPDX-License-Identifier: MIT and nothing else") == ["mit"]


def test_sentences_are_counted_once(spark):
    rows = [(1, "Dual-licensed under the MIT license and the GNU General Public License, version 2.")]
    assert [(r["n_license_sentences"], r["licenses"]) for r in L.scan(docs(spark, rows)).collect()] == [(1, ["MIT", "GPL-2.0"])]


def test_rules_need_their_sentences_in_order():
    assert licences(MIT) == ["MIT"]
    assert licences("\n".join("// " + x for x in MIT.split("\n"))) == ["MIT"]
    assert licences(BSD) == ["BSD-3-Clause"]
    assert licences(BSD.replace("Neither the name of X nor the names of its contributors may be used to endorse or promote products.\n", "")) == ["BSD-2-Clause"]
    got, rest = L.match_rules([("BSDAsIs", ""), ("BSDBinary", ""), ("BSDSource", ""), ("BSDRedistribution", "")])
    assert got == [] and len(rest) == 4


def test_scan_matches_a_line_by_line_reading(spark):
    rows = [(i, t) for i, t in enumerate([MIT, BSD, "no licence", "Released under the MIT License.\n\nAll rights reserved.", None, ""])]
    got = {r["doc_id"]: r["licenses"] for r in L.scan(docs(spark, rows)).collect()}
    assert got == {0: ["MIT"], 1: ["BSD-3-Clause"], 2: [], 3: ["MIT", "Proprietary"], 4: [], 5: []}


def test_odd_input(spark):
    assert L.scan(odd(spark)).where("n_license_sentences = 0 and size(licenses) = 0").count() == 10
    assert L.scan(empty(spark)).count() == 0
    long = "word " * 50_000 + ".\nReleased under the MIT License.\n" + "word " * 50_000
    assert licences(long) == ["MIT"]


def test_clauses_versions_and_refusals():
    assert licences("Licensed under the 2-clause BSD license.") == ["BSD-2-Clause"]
    assert licences("Licensed under the BSD-3-Clause license.") == ["BSD-3-Clause"]
    assert licences("Licensed under the original BSD license.") == ["BSD-4-Clause"]
    assert licences("You may use it under the GNU Lesser General Public License, version 2.1.") == ["LGPL-2.1"]
    assert licences("You may use it under version 3 of the GNU Lesser General Public License.") == ["LGPL-3.0"]
    assert licences("This is not licensed under the MIT license.") == []
    assert licences("The program is no longer distributed under the MIT license.") == []
    assert licences("If not, see the GNU General Public License, version 3.") == ["GPL-3.0"]


def test_one_spelling_of_a_licence(spark):
    text = "# SPDX-License-Identifier: Apache-2.0\n\nLicensed under the Apache License, Version 2.0.\n\nSPDX-License-Identifier: GPL-2.0 WITH Some-exception-1.0"
    assert L.scan(docs(spark, [(1, text)])).first()["licenses"] == ["Apache-2.0", "GPL-2.0 with some-exception-1.0"]


def test_hints_lose_no_sentence(spark):
    """Against a reading of every sentence of every text, without hints."""
    texts = [r["text"] or "" for r in table(spark, SF2, "documents").select("text").collect()] + [MIT, BSD, GNU]
    hits = 0
    for t in texts:
        bare = L._COMMENT.sub("", t)
        want = [x for a, b in L.sentences(bare) for x in L.known(L.normalise(bare[a:b]))]
        assert L.identify(t) == want
        hits += bool(want)
    assert hits > 20


BSD4 = """Copyright (c) 1990 The Regents. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice. All advertising materials mentioning features or use of this software must display the following acknowledgement: X.
Neither the name of the University may be used to endorse or promote products. This software is provided by the Regents "as is"."""


def licenses(text):
    return list(dict.fromkeys(map(L.spelt, L.match_rules(L.identify(text))[0])))


def test_notices_with_their_copyright_line():
    assert licenses(BSD4) == ["BSD-4-Clause"]
    three = BSD4[: BSD4.index("All advertising")] + BSD4[BSD4.index("Neither") :]
    assert licenses(three) == ["BSD-3-Clause"]
    assert licenses(three[: three.index("Neither")] + three[three.index("This software") :]) == ["BSD-2-Clause"]
    mit = 'Copyright 2020 A. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and this permission notice shall be included. The software is provided "as is", without warranty of any kind.'
    assert licenses(mit) == ["MIT"] and licenses(mit + "\n\nAll rights reserved.") == ["MIT", "Proprietary"]
    assert licenses("Copyright 2020 A. All rights reserved.") == ["Proprietary"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Under Creative Commons Attribution-NonCommercial 4.0.", ["CC-BY-NC"]),
        ("Under Creative Commons Attribution-ShareAlike 4.0.", ["CC-BY-SA"]),
        ("Under Creative Commons Attribution-NonCommercial-ShareAlike 4.0.", ["CC-BY-NC-SA"]),
        ("Under Creative Commons Attribution-NonCommercial-NoDerivatives 4.0.", ["CC-BY-NC-ND"]),
        ("Under Creative Commons Attribution-NoDerivs 3.0.", ["CC-BY-ND"]),
        ("Under Creative Commons Attribution 4.0.", ["CC-BY"]),
        ("This software is provided 'as-is', without any express or implied warranty. The origin of this software must not be misrepresented. Altered source versions must be plainly marked as such.", ["Zlib"]),
        ("Eclipse Public License - v 2.0", ["EPL-2.0"]),
        ("Eclipse Public License 1.0", ["EPL-1.0"]),
        ("Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software.", ["BSL-1.0"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
        ("This program is free software: you can redistribute it and/or modify it under the GNU General Public License, either version 4 of the License, or (at your option) any later version.", ["GPL"]),
    ],
)
def test_variants(text, want):
    assert licenses(text) == want


def plain_rules(found):
    left, got = list(enumerate(found)), []
    for needed, licence in L.RULES:
        while True:
            used, want = [], 0
            for place, (name, part) in left:
                if want < len(needed) and name == needed[want]:
                    used.append((place, part))
                    want += 1
            if want < len(needed):
                break
            got.append((used[0][0], used[0][1] or licence))
            gone = {p for p, _ in used}
            at = used[0][0] - 1
            there = dict(left)
            while licence != "Proprietary" and at in there and there[at][0] in ("Copyright", "AllRights"):
                if there[at][0] == "AllRights":
                    gone.add(at)
                at -= 1
            left = [x for x in left if x[0] not in gone]
    return [x for _, x in sorted(got)], [name for _, (name, _) in left]


def test_rules_equal_a_plain_reading():
    rnd = random.Random(2)
    names = [n for n, _ in L.SENTENCES]
    for _ in range(300):
        some = rnd.sample(names, 8) + ["Copyright", "AllRights"]
        found = [(rnd.choice(some), "") for _ in range(rnd.randint(0, 60))]
        assert L.match_rules(found) == plain_rules(found)


def test_long_texts_with_many_names_take_linear_time():
    one = "Licensed under the MIT license and the Apache License, Version 2.0, not under the GNU General Public License, "
    begin = time.time()
    for text in (one * 12_500, one.replace(", ", ".\n") * 12_500, "neither the name of x this software is provided by " * 20_000):
        L.match_rules(L.identify(text))
    assert time.time() - begin < 60
    assert len(L.identify(one * 12_500)) == 25_000
