"""Real licence notices and the labels that the license scan has to give them."""

import pytest

from tests.llm.test_llm import by_id
from tidemark.llm import license_scan

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
MIT_END = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'

NOTICES = [
    (f"{MIT}, subject to the following conditions: {MIT_END} {AS_IS}", "mit,no-warranty"),
    (f"{MIT}. {AS_IS}", "mit,mit-0,no-warranty"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: MIT-0", "mit-0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
    ("# SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
    ("SPDX-License-Identifier: AGPL-3.0", "agpl"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa"),
    ("SPDX-License-Identifier: CC0-1.0", "cc0"),
    ("SPDX-License-Identifier: Unlicense", "unlicense"),
    ("SPDX-License-Identifier: BSL-1.0", "boost"),
    ("SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: Zlib", "zlib"),
    ("SPDX-License-Identifier: 0BSD", "0bsd"),
    ("SPDX-License-Identifier: BUSL-1.1", "busl"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"),
    ("SPDX-License-Identifier: EPL-2.0 OR GPL-2.0-only", "epl,gpl-2.0"),
    ("CC0: no rights reserved", "cc0,public-domain"),
    ("Some rights reserved.", "reserved"),
    ("All rights reserved.", "reserved"),
    ("Tous droits réservés.", "reserved"),
    ("TOUS DROITS RÉSERVÉS", "reserved"),
    ("Alle Rechte vorbehalten.", "reserved"),
    ("Todos los derechos reservados", "reserved"),
    ("Tutti i diritti riservati", "reserved"),
    ("Este libro: prohibida la reproducción total o parcial.", "proprietary"),
    ("Toute reproduction, même partielle, est interdite.", "proprietary"),
    ("Die Vervielfältigung ist nicht gestattet.", "proprietary"),
    ("Dieses Werk ist urheberrechtlich geschützt.", "reserved"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2.0"),
    ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3.0"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "gpl"),
    ("You should have received a copy of the GNU Lesser General Public License", "gpl,lgpl"),
    ("You should have received a copy of the GNU Affero General Public License", "agpl,gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived", "bsd-3-clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("The origin of this software must not be misrepresented; you must not claim", "zlib"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS", "0bsd"),
    ("Text is available under the Creative Commons Attribution-ShareAlike License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License: https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc,cc-by-nc-nd"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl"),
    ("The Software shall be used for Good, not Evil.", "json"),
    ("This software is based in part on the work of the Independent JPEG Group", "ijg"),
    ("Contains public sector information licensed under the Open Government Licence v3.0.", "ogl"),
    ("Licence Ouverte 2.0 / Etalab", "etalab"),
    ("Datenlizenz Deutschland – Namensnennung", "dl-de"),
    ("Use is governed by the Llama 3 Community License", "llama"),
    ("Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.", "proprietary"),
    ("For internal use only", "proprietary"),
    ("Text and data mining is not permitted", "no-ai"),
    ("The licence of a driver costs money; mit dem Zug nach Isc", ""),
    ("He reserved a table with rights of way.", ""),
    ("An identifier of the license plate", ""),
    ("The MIT is in Cambridge, and the apache helicopter flew.", ""),
]


def test_notices(spark):
    got = by_id(license_scan.license_scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(NOTICES)], "doc_id long, text string")))
    wrong = [(t[:60], want, got[k]["labels"]) for k, (t, want) in enumerate(NOTICES) if got[k]["labels"] != want]
    assert not wrong


@pytest.mark.parametrize("name", [x for _, xs in license_scan.SPDX for x in xs.split()][::7])
def test_short_names(name):
    label = next(label for label, xs in license_scan.SPDX if name in xs.split())
    words = ["spdx", "license", "identifier", *__import__("re").findall("[a-z0-9]+", name.lower())]
    assert {r.label for _, _, r in license_scan.scan_words(words, license_scan.keyed(license_scan.rules()))} == {label}
