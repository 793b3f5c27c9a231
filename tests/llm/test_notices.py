"""Licence notices with prefixes, of several sentences and over several lines."""

from codeloom.llm import licenses

# Fixed value: the public notice.
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
CASES = {
    "Copyright 2021 Jane Doe. Released under the MIT License.": {"mit"},
    " ".join(licenses.TEMPLATES["apache"][1:]): {"apache"},
    MIT: {"mit"},
    "/* Copyright (c) 2019 The Authors. All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. */": {"bsd"},
    "# Licensed under the Apache License, Version 2.0 (the \"License\"); you may\n# not use this file except in compliance with the License.": {"apache"},
    "Jane Doe, 2021. Licensed under the\nMozilla Public License, version 2.0.": {"mpl", "unknown"},  # the first line's words don't tell the family
    "// SPDX-License-Identifier: MIT": {"mit"},
    "# SPDX-License-Identifier: LGPL-2.1-or-later": {"lgpl"},
    "Copyright (C) 2020 J. Doe\n\nThis library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": {"gpl", "lgpl", "unknown"},  # as above; a line has words of both families
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": {"isc"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": {"mit"},
    "SPDX-License-Identifier: Acme-1.0": {"unknown"},
    "She was licensed under state law to teach.\nThe driver's license was lost in May.": {"unknown"},
}


def test_prefixed_joined_and_wrapped_notices(spark):
    docs = spark.createDataFrame([(i, "some words\n" + t + "\n\nmore words") for i, t in enumerate(CASES)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.id, {}).setdefault(r.family, []).append((r.paragraph, r.probability, r.similarity))
    assert {i: set(f) for i, f in got.items()} == dict(enumerate(CASES.values())), got
