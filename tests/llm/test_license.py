import random

import numpy as np

from skarn.llm import license as lic
from skarn.llm.queries import queries


def test_held_out_accuracy():
    rows = lic.examples(1500, 77)
    model = lic.model()
    right = wrong = 0
    for text, k in rows:
        z = model.logits(text) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax()) if p.max() >= lic.MIN_PROBABILITY else 0
        right += best == k
        wrong += best not in (0, k)
    assert right / len(rows) > 0.95 and wrong / len(rows) < 0.01
    assert len(model.weights) < 800


def test_plain_lines_and_odd_rows(spark):
    rows = [
        (1, "Prose of the day.\nLicensed under the Apache License, Version 2.0.\nMore prose."), (2, "Released under the MIT License."),
        (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY 4.0."),
        (6, "His driving license expired."), (7, None), (8, ""), (None, "Released under the MIT License.\n\nLicensed under CC BY-SA 4.0."), (2, "Released under the MIT License."),
        (9, "word " * 20000 + "licensed"), (10, "licen"),
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, families string")
    got = lic.scan(frame).collect()
    assert len(got) == len(rows)
    families = {r.doc_id: (r.families, r.first_line) for r in got}
    assert families == {1: ("apache-2.0", 1), 2: ("mit", 0), 3: ("gpl", 0), 4: ("cc-by-nc", 0), 5: ("cc-by", 0), 6: ("", -1), 7: ("", -1), 8: ("", -1), None: ("cc-by-sa,mit", 0), 9: ("", -1), 10: ("", -1)}
    assert lic.scan(frame.limit(0)).count() == 0


def test_projection_equals_driver_sums(spark):
    rows = lic.examples(120, 3)
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = lic.model()
    for r in lic.paragraphs(frame).collect():
        z = model.logits(rows[r.doc_id][0]) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        want = lic.CLASSES[int(p.argmax())] if p.max() >= lic.MIN_PROBABILITY else lic.UNKNOWN
        assert abs(r.found[0].probability - p.max()) < 1e-9 and r.found[0].family == want


def test_query_is_native(spark):
    frame = queries()["op1_license"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert frame.filter("n_licences > 0").count() > 0


def test_wrapped_notices(spark):
    rows = [
        ("mpl", 0, "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"),
        ("mpl", 1, "Some prose goes before it.\nThis is subject to the\nterms of the Mozilla\nPublic License, v. 2.0.\nAnd some prose after it."),
        ("isc", 2, "Copyright (c) 2020 A B\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
        ("bsd", 2, "Copyright (c) 2020, A B\n\nRedistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:"),
        ("", -1, "The terms of the\n\nMozilla\n\nPublic wrote this in a free\nstyle."), ("", -1, "Er kam mit der Bahn und\nging mit ihr nach Haus."),
    ]
    frame = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan(frame).collect()}
    assert [(got[i].families, got[i].first_line, got[i].n_licences) for i in range(len(rows))] == [(f, line, int(line >= 0)) for f, line, _ in rows]
    assert got[5].n_unconfirmed == 0
    lines = [line for _, _, t in rows for line in t.split("\n")]
    featured = sum(any(g in lic.model().weights for g in lic.grams_of(line)) for line in lines)
    assert sum(r.n_candidates for r in got.values()) >= featured


HEADERS = {
    "mit": ["MIT License", "The MIT License (MIT)", 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights'],
    "apache-2.0": ["Apache License", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,"],
    "gpl": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"],
    "lgpl": ["GNU LESSER GENERAL PUBLIC LICENSE"], "agpl": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "bsd": ["BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE'],
    "mpl": ["Mozilla Public License Version 2.0"], "isc": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."], "cc-by-sa": ["Licensed under CC BY-SA 4.0"], "cc-by-nc": ["Licensed under CC BY-NC 4.0"], "cc-by-nd": ["Licensed under CC BY-ND 4.0"],
    "cc0": ["CC0 1.0 Universal (Public Domain Dedication)"], "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled binary"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without permission."],
}


def test_hand_written_headers_of_every_family():
    assert set(HEADERS) == set(lic.FAMILIES)
    for family, texts in HEADERS.items():
        for text in texts:
            assert lic.brute_force(text)[2] == family, text


def test_scan_against_brute_force(spark):
    rng = random.Random(21)
    headers = [t for texts in HEADERS.values() for t in texts]
    texts = [None, "", "\n\n", *headers[:6]]
    for _ in range(30):
        parts = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice([*headers, *(t for t, _ in lic.examples(5, rng.randrange(1000)))]).split()
            cut = words[rng.randint(0, 3) :][: rng.randint(3, 40)]
            parts.append("".join(w + rng.choice([" ", " ", " ", " ", "\n", "\n\n"]) for w in cut))
        texts.append(rng.choice(["\n", " ", "\n\n"]).join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in lic.scan(frame).collect()}
    assert got == {i: lic.brute_force(t) for i, t in enumerate(texts)}
