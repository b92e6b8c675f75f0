"""Hand-written license rules: each found by its own wording behind its keyword, real notices and bodies, wrapped and commented."""

import re

import pytest

from lorekeep.llm import license_rules, licenses
from tests.llm.helpers import by_id, docs
from tests.llm.test_text_operators import expansions

WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n'
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\n"
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE.")
GRANT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal\n'
         "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
         "copies of the Software, and to permit persons to whom the Software is furnished to do so")
MIT = (f"Copyright (c) 2020 Somebody. All rights reserved.\n\n{GRANT}, subject to the following conditions:\n\n"
       f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{WARRANTY}")
CONDITIONS = ("Copyright (c) 2001, Somebody\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following\n"
              "conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
              "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation\n"
              "   and/or other materials provided with the distribution.\n")
ADVERTISING = ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software\n"
               "   developed by Somebody.\n")
NEITHER = ("3. Neither the name of Somebody nor the names of its contributors may be used to endorse or promote products derived from this software without specific\n"
           "   prior written permission.\n")
DISCLAIMER = ('\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED\n'
              "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DIRECT, INDIRECT,\n"
              "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE)")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}\n\n"
       'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,\n'
       "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS")
GNU = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {0}General Public License as published by\n"
       "# the Free Software Foundation, either version {1} of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n"
       "# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU {0}General Public License for more details.\n#\n"
       "# You should have received a copy of the GNU {0}General Public License\n# along with this program.  If not, see <https://www.gnu.org/licenses/>.\n")
APACHE = (' * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n'
          " *     http://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an \"AS IS\" BASIS,\n"
          " * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n * See the License for the specific language governing permissions and\n * limitations under the License.\n")
ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of\n"
        "this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,\n"
        "subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.")
NOTICES = {
    "mit": MIT, "mit-0": f"{GRANT}.\n\n{WARRANTY}",
    "bsd-2-clause": CONDITIONS + DISCLAIMER, "bsd-3-clause": CONDITIONS + NEITHER + DISCLAIMER, "bsd-4-clause": CONDITIONS + ADVERTISING + NEITHER.replace("3", "4") + DISCLAIMER,
    "isc": ISC.format(", provided that the above\ncopyright notice and this permission notice appear in all copies."), "0bsd": ISC.format("."),
    "gpl-2.0-or-later": GNU.format("", "2"), "gpl-3.0-or-later": GNU.format("", "3"), "lgpl-2.1-or-later": GNU.format("Lesser ", "2.1"), "agpl-3.0-or-later": GNU.format("Affero ", "3"),
    "gpl-2.0-only": "you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.",
    "apache-2.0": APACHE, "zlib": ZLIB,
    "mpl-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0\nwhich accompanies this distribution",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License, http://creativecommons.org/licenses/by-nc-sa/4.0/",
    "cc-by-sa": "Text is available under https://creativecommons.org/licenses/by-sa/3.0/",
    "cc-by": "licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "proprietary": "Unauthorized copying of this file, via any medium is strictly prohibited.", "artistic-perl": "you can redistribute it and/or modify it under the same terms as Perl itself.",
}


@pytest.mark.parametrize("label", NOTICES)
def test_notices_and_bodies_carry_their_own_label_alone(label):
    found = licenses.Scanner().detections(NOTICES[label].lower())
    names = {d["label"] for d in found}
    assert label in names
    assert {n.split("-")[0] for n in names} == {label.split("-")[0]}, names
    if label not in ("epl-2.0", "apache-2.0"):
        assert names == {label}


def test_every_rule_is_found_by_its_own_wording():
    scanner = licenses.Scanner()
    assert len(license_rules.RULES) > 200
    for label, keywords, priority, _, wording in license_rules.RULES:
        plain = re.sub(r"\[\\s\\S\]\{[\d,]+\}\?|…", " somebody ", wording).replace(r"\\b", "").replace(r"\b", "").replace(r"\d", "3").replace(r"\w", "a").replace(r"\+", "plus")
        texts = [t.replace("plus", "+") if r"\+" in wording else t for t in expansions(re._parser.parse(plain))]
        pattern = license_rules.compiled(wording)
        fitting = [t for t in texts if pattern.search(t)]
        assert fitting, (label, wording, texts[:2])
        for text in fitting:
            assert any(k in text for k in keywords.split("|")), (label, text)
        spans = [d["label"] for t in fitting for d in scanner.detections(t)]
        # A wording alone may lose to a sibling's that says more, never to nothing.
        assert label in spans or any(s.split("-")[0] == label.split("-")[0] for s in spans), (label, wording, set(spans))


def test_prose_that_only_sounds_alike_is_left_alone(spark):
    texts = ["The permission was granted, free of charge, to any visitor.", "A mit of wool, a license plate, and the general public.", "The apache helicopters flew over Boost.",
             "Gnu and zebra live together; redistribution of wealth is another matter.", "", None, "neither the name of the rose nor " + "word " * 50_000]
    rows = by_id(licenses.scan(docs(spark, list(enumerate(texts)))))
    assert all(rows[i].detections == [] for i in range(len(texts)))
