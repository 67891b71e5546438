from corpusloom.llm import licences


def test_every_known_sentence_has_a_marker():
    for sentence in licences.SENTENCES.values():
        assert any(m in sentence for m in licences.MARKERS)
    assert {s for sequence, _ in licences.RULES for s in sequence} <= set(licences.SENTENCES)


def test_rules_in_order(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in\ncompliance with the License. You may obtain a copy of the License at:\nhttp://x"
    rows = [
        (1, "Intro text\nReleased under the MIT License.\nMore. LICENSED UNDER CC BY-NC 4.0."),
        (2, apache),
        (3, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Nothing."),
        (4, None),
        (5, ""),
        (6, "word " * 50_000 + "x. This work is licensed under the GNU General Public License, version 3. " + "y. " * 1000 + "Released under the MIT License. Released under the MIT License."),
        (None, "Released under the MIT License. extra"),
        (1, "unreleased under the mit licenses."),
        (7, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as sentences", "1 as licences")
    got = sorted((r.doc_id or 0, list(r.sentences), list(r.licences), list(r.unmatched)) for r in licences.scan_licences(docs).collect())
    assert got == [
        (0, ["mit-name"], ["MIT"], []),
        (1, [], [], []),
        (1, ["mit-name", "cc-by-nc"], ["MIT", "CC-BY-NC-4.0"], []),
        (2, ["ap-head", "ap-use"], [], ["ap-head", "ap-use"]),
        (3, ["bsd-use"], [], ["bsd-use"]),
        (4, [], [], []),
        (5, [], [], []),
        (6, ["gpl-name", "mit-name", "mit-name"], ["GPL-3.0-only", "MIT"], []),
        (7, ["gpl-free", "gpl-terms2", "gpl-v2"], ["GPL-2.0-or-later"], []),
    ]
    assert licences.scan_licences(docs.limit(0)).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
"""


def test_standard_notices_as_they_stand(spark):
    notices = [
        (APACHE, ["Apache-2.0"]),
        (MPL, ["MPL-2.0"]),
        (GPL % (":", ",", 3), ["GPL-3.0-or-later", "GPL-notice"]),
        (GPL % (";", ";", 2), ["GPL-2.0-or-later", "GPL-notice"]),
        (BSD, ["BSD-2-Clause"]),
        (BSD + BSD_NAME, ["BSD-3-Clause"]),
        (MIT, ["MIT"]),
    ]
    comment = lambda text: "/*\n" + "".join(f" * {x}\n" for x in text.split("\n")) + " */"
    names = [
        ("Licensed under the Apache License, Version 2.0 by the authors.", ["Apache-2.0"]),
        ("It is licensed under CC BY 4.0 - see below. And licensed under CC BY-SA 4.0 too", ["CC-BY-4.0", "CC-BY-SA-4.0"]),
        ("Released under the MIT license and this work is licensed under the GNU General Public License, version 3", ["MIT", "GPL-3.0-only"]),
        ("This work is licensed under the GNU General Public License, version 3 or (at your option) any later version.", []),
    ]
    rows = [(t, w, True) for t, w in notices] + [(comment(t), w, True) for t, w in notices] + [(t, w, False) for t, w in names]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    for r in licences.scan_licences(docs).collect():
        _, want, whole = rows[r.doc_id]
        assert list(r.licences) == want and list(r.unmatched) == [], (r, want)
        assert not whole or len(r.sentences) > 1
