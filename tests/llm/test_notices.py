"""Licence notices as they stand in real files: over several lines, with comment prefixes and stops inside."""

from weftnet.llm import licences

GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def test_real_notices(spark):
    rows = [(1, GPL), (2, MPL), (3, APACHE), (4, GPL.replace("\n", "\r\n")), (5, "prose\nAll rights reserved\nprose"), (6, "not all rights reserved.")]
    out = {r.doc_id: r for r in licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licence for i, r in out.items()} == {6: None, 1: "GPL-3.0-or-later", 2: "MPL-2.0", 3: "Apache-2.0", 4: "GPL-3.0-or-later", 5: "Proprietary"}
    assert out[1].rule == out[4].rule == "gpl-free gpl-no-warranty"
    assert out[3].sentences == "apache-named apache-compliance apache-copy as-is"
    assert all(any(h in w for h in licences.HINTS) for wordings in licences.SENTENCES.values() for w in wordings)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
FOURTH = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software.
"""
MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty.
In no event will the authors be held liable.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0"""


def test_breadth_of_notices(spark):
    gnu = lambda name, version: GPL.replace("GNU General Public License as", f"GNU {name} as").replace("either version 3", f"either version {version}")
    only = GPL.replace("either version 3 of the License, or\n# (at your option) any later version.", "version 2 of the License.")
    want = [(BSD, "BSD-2-Clause"), (BSD + THIRD, "BSD-3-Clause"), (BSD + FOURTH, "BSD-4-Clause"), (MIT, "MIT"), (ISC, "ISC"), (ZLIB, "Zlib"), (EPL, "EPL-2.0")]
    want += [(gnu("General Public License", "2"), "GPL-2.0-or-later"), (only, "GPL-2.0-only"), (gnu("Affero General Public License", "3"), "AGPL-3.0-or-later")]
    want += [(gnu("Lesser General Public License", "2.1").replace("This program", "This library"), "LGPL-2.1-or-later"), (gnu("Lesser General Public License", "3"), "LGPL-3.0-or-later")]
    want += [("This is free and unencumbered software released into the public domain.", "Unlicense"), ("This work is licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("plain words", None), (None, None), ("", None)]
    for wrapped in (lambda t: t, lambda t: t and "\n\n".join(" ".join(part.split("\n")) for part in t.split("\n\n")), lambda t: t and "\n".join(f" * {x}" for x in t.split("\n"))):
        rows = [(i, wrapped(t), licence) for i, (t, licence) in enumerate(want)]
        out = licences.recognise(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()
        assert [(r.doc_id, r.licence) for r in out if r.licence != r.want] == []


def test_rows_of_one_key(spark):
    rows = [(1, MIT), (1, "Plain text."), (None, GPL), (None, "More."), (None, GPL)]
    out = licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.licence or "") for r in out) == [(0, ""), (0, "GPL-3.0-or-later"), (0, "GPL-3.0-or-later"), (1, ""), (1, "MIT")]
    assert licences.recognise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_names_tails_and_several_licences(spark):
    """Holders by name, words after a wording, tags, and texts with more than one licence."""
    holder = THIRD.replace("the copyright holder", "Acme Inc.")
    cases = [
        (BSD + holder, "BSD-3-Clause"),
        (BSD + THIRD.replace("the copyright holder", "the Board of Trustees of the\n   University of Somewhere, Ltd."), "BSD-3-Clause"),
        (BSD + THIRD.replace("the copyright holder", " ".join(f"w{i}" for i in range(13))), "BSD-2-Clause"),
        (BSD, "BSD-2-Clause"),
        ("The MIT License.\n\nLicensed under the Apache License, Version 2.0.", "Apache-2.0 MIT"),
        (GPL + "\n" + BSD + holder + "\nAll rights reserved.", "GPL-3.0-or-later BSD-3-Clause"),
        ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("/* SPDX-License-Identifier: MIT */\nint x;", "MIT"),
        ("Released under the MIT License by Acme.", "MIT"),
        ("GNU General Public License version 3 or later", "GPL-3.0-or-later"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License (https://creativecommons.org/licenses/by/4.0/).", "CC-BY-4.0"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("3-clause BSD license", "BSD-3-Clause"),
        ("# SPDX-License-Identifier: LGPL-3.0-only", "LGPL-3.0-only"),
        ("Released under the MIT License bylaws.", ""),
        ("He kept all rights reserved for himself.", ""),
        ("All rights reserved.", "Proprietary"),
        ("", ""),
    ]
    out = licences.recognise(spark.createDataFrame([(i, t, w, "x") for i, (t, w) in enumerate(cases)], "doc_id long, text string, want string, licences string")).collect()
    assert [(r.doc_id, r.licences) for r in out if r.licences != r.want] == []
    assert all(r.licence == (r.want.split() or [None])[0] for r in out)
