"""License scans by ordered signature rules (operator 3).

Rules are over 130 written sentences of licence texts and notices, the names of licences in the ways to state
one, and the short names of the SPDX list after their tag. A rule is a regex over a text's words (in lower case
and without accents, joined by single spaces), keywords of which every match holds one, a priority and a confidence. Keywords are looked up in the words' dictionary, so a text
without them never meets a regex, and loses nothing by that. Among overlapping detections, one that lies inside a detection of at least
its priority is suppressed. Three base phrases are always counted by word position.

Defined results: null text is empty: no words, no labels, score 0, null positions. Rows are scanned
one by one, so repeated rows and extra columns need no rule; an empty table gives no rows; of detections that tie in
priority the longer, then the earlier suppresses; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import textkit as tk

#: Base phrases and their labels; fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, keywords (every alternative of the regex holds one of them as a whole word), regex of the licence's name over normalised words.
NAMES = (
    ("agpl", "affero|agpl|agpl3|agplv3", r"(?:gnu )?affero general public licen[sc]e(?: version 3| v3)?|agpl(?: ?v?3)?"),
    ("lgpl", "lesser|library", r"(?:gnu )?(?:lesser|library) general public licen[sc]e(?: version [23](?: 1)?| v[23](?: 1)?)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[sc]e (?:version |v)?3(?: 0)?(?: or(?: any)? later)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[sc]e (?:version |v)?2(?: 0)?(?: or(?: any)? later)?"),
    ("gpl", "gpl|gpl1|gpl2|gpl3|gplv1|gplv2|gplv3", r"gpl(?: ?v?[123](?: 0)?)?"),
    ("gpl", "gnu", r"gnu general public licen[sc]e"),
    ("gfdl", "documentation", r"gnu free documentation licen[sc]e(?: version 1 [0-3])?"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("mit", "mit", r"mit(?: x11)? licen[sc]e"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?"),
    ("bsd", "bsd", r"(?:original |4 clause )?bsd(?: style)? licen[sc]e"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e(?:(?: version)? 1 [01])?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e(?: version| v)?(?: [12](?: 0)?)?"),
    ("cddl", "cddl|distribution", r"common development and distribution licen[sc]e|cddl(?: 1 [01])?"),
    ("cpl", "common", r"common public licen[sc]e(?: version)?(?: 1 0)?"),
    ("eupl", "eupl|european", r"european union public licen[sc]e|eupl(?: 1 [012])?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("boost", "boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e(?: 2 0)?"),
    ("python", "python", r"python(?: software foundation)? licen[sc]e(?: version 2)?"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("php", "php", r"php licen[sc]e(?: version)?(?: 3 0[01])?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("wtfpl", "wtfpl|want", r"wtfpl|do what the f\w+ you want to public licen[sc]e"),
    ("unlicense", "unlicense|unlicence", r"(?:the )?unlicen[sc]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "nd|noderivatives|noderivs", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivatives|noderivs)(?: [1234] \d)?"),
    ("cc-by-nc-sa", "sa|sharealike|alike", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)(?: [1234] \d)?"),
    ("cc-by-nc", "nc|noncommercial|commercial", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)(?: [1234] \d)?"),
    ("cc-by-nd", "nd|noderivatives|noderivs", r"(?:cc|creative commons) (?:by|attribution) (?:nd|noderivatives|noderivs)(?: [1234] \d)?"),
    ("cc-by-sa", "sa|sharealike|alike", r"(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike|share alike)(?: [1234] \d)?"),
    ("cc-by", "cc", r"cc by(?: [1234] \d)?"),
    ("cc", "creative", r"creative commons(?: \w+){0,3} licen[sc]e"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain|public domain dedication"),
    ("ogl", "government", r"open government licen[sc]e(?: v?[123](?: 0)?)?"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[sc]e"),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])?"),
    ("ms-pl", "microsoft", r"microsoft (?:public|reciprocal) licen[sc]e"),
    ("reserved", "rights|rechte|droits|derechos", r"all rights reserved|alle rechte vorbehalten|tous droits reserves|todos los derechos reservados"),
)

#: Signature sentences of licence texts and notices: label, keywords (one of which every match holds), regex over normalised words.
SENTENCES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "deal", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit-0", "furnished", r"permit persons to whom the software is furnished to do so the software is provided as is"),
    ("0bsd", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,60} (?:nor the names of its contributors )?may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("no-warranty", "merchantability", r"(?:the )?implied warranties of merchantability(?: and)? fitness for a particular purpose"),
    ("no-warranty", "kind", r"provided (?:by the copyright holders and contributors )?as is without warrant(?:y|ies) of any kind"),
    ("no-warranty", "liable", r"in no event shall the (?:authors|copyright holders?|regents)(?: or (?:copyright holders?|contributors))? be liable"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2.0", "either", r"general public licen[sc]e as published by the free software foundation either version 2"),
    ("gpl-3.0", "either", r"general public licen[sc]e as published by the free software foundation either version 3"),
    ("gpl", "useful", r"in the hope that it will be useful but without any warranty"),
    ("gpl", "received", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl", "remotely", r"users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "www", r"www apache org licenses license 2 0"),
    ("apache-2.0", "agreed", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("apache-1.1", "includes", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("mpl", "mozilla", r"subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "source", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0"),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licenses"),
    ("epl", "accompanying", r"(?:this program and the )?accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl", "cddl", r"the contents of this file are subject to the terms of the (?:common development and distribution licen[sc]e )?cddl"),
    ("cpl", "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("boost", "boost", r"distributed under the boost software licen[sc]e version 1 0"),
    ("boost", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate|dedication", r"we make this dedication for the benefit of the public at large|dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "0", r"0 you just do what the f\w+ you want to"),
    ("artistic", "artistic", r"you may distribute under the terms of either the gnu general public licen[sc]e or the artistic licen[sc]e"),
    ("artistic", "perl", r"same terms as perl itself"),
    ("python", "psf", r"psf is making python available to licensee"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("postgresql", "agreement", r"without fee and without a written agreement is hereby granted"),
    ("x11", "consortium", r"the name of the x consortium shall not be used in advertising"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e"),
    ("ofl", "font", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", "reserved", r"with reserved font names?"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("ms-pl", "contribution", r"each contributor grants you a non exclusive worldwide royalty free (?:copyright|patent) licen[sc]e to (?:reproduce )?its contribution"),
    ("cc-by", "appropriate", r"free to share (?:.{1,60} )?adapt (?:.{1,80} )?appropriate credit"),
    ("cc-by", "attribution", r"creative commons attribution(?: 4 0| 3 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-sa", "sharealike|alike", r"creative commons attribution share ?alike(?: 4 0| 3 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-nc", "noncommercial|commercial", r"creative commons attribution non ?commercial(?: 4 0| 3 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-nc-sa", "sharealike|alike", r"creative commons attribution non ?commercial share ?alike(?: 4 0| 3 0)?(?: international| unported)? licen[sc]e"),
    ("cc-by-nd", "noderivatives|derivatives|noderivs|derivs", r"creative commons attribution no ?(?:derivatives|derivs)(?: 4 0| 3 0)?(?: international| unported)? licen[sc]e"),
    ("cc0", "waived", r"waived all copyright and related or neighboring rights"),
    ("cc", "creativecommons", r"creativecommons org licenses by(?: nc| nd| sa)*(?: \d \d)?"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", "domain", r"(?:has been|is hereby|was) (?:placed|released|put) (?:in|into) the public domain"),
    ("public-domain", "domain|claimed", r"no copyright is claimed|this (?:work|file|code|text) is in the public domain"),
    ("odbl", "odbl|database", r"open database licen[sc]e odbl|made available under the open database licen[sc]e"),
    ("ogl", "government", r"contains public sector information licensed under the open government licen[sc]e"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:of this (?:file|work|document) |or distribution )?(?:via any medium )?is (?:strictly )?prohibited"),
    ("proprietary", "permission", r"may not be (?:reproduced|copied|published|broadcast|rewritten|redistributed)(?: or \w+)* without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("proprietary", "trade", r"contains trade secrets of"),
    ("proprietary", "evaluation", r"for evaluation purposes only"),
    ("non-commercial", "commercial|noncommercial", r"for non ?commercial (?:use|purposes) only|free for non ?commercial use"),
    ("non-commercial", "personal", r"for personal (?:and non ?commercial )?use only"),
    ("academic", "academic", r"for academic (?:and research )?(?:use|purposes) only"),
    ("academic", "research", r"for research (?:use|purposes) only"),
    ("reserved", "reserved", r"some rights reserved"),
    ("public-domain", "reserved", r"no rights reserved"),
    ("reserved", "reserves", r"the author reserves all rights"),
    ("reserved", "vorbehalten", r"alle rechte (?:sind )?vorbehalten|nachdruck (?:auch auszugsweise )?(?:nur mit genehmigung|verboten) (?:ist )?vorbehalten"),
    ("reserved", "reserves", r"tous (?:les )?droits (?:de reproduction )?(?:sont )?reserves"),
    ("reserved", "riservati", r"tutti i diritti (?:sono )?riservati"),
    ("reserved", "voorbehouden", r"alle rechten voorbehouden"),
    ("reserved", "urheberrechtlich", r"urheberrechtlich geschutzt"),
    ("reserved", "auteur", r"protege par le droit d auteur"),
    ("reserved", "derechos", r"reservados todos los derechos"),
    ("upl", "universal", r"universal permissive licen[sc]e"),
    ("ecl", "educational", r"educational community licen[sc]e"),
    ("afl", "academic", r"licensed under the academic free licen[sc]e"),
    ("osl", "osl|open", r"licensed under the open software licen[sc]e"),
    ("cecill", "cecill", r"(?:regi|governed) (?:par|by) (?:la licence|the) cecill"),
    ("lppl", "latex", r"latex project public licen[sc]e"),
    ("mulan", "mulan", r"licensed under mulan psl v2"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("beerware", "beer", r"(?:you can )?buy me a beer in return"),
    ("ijg", "independent", r"this software is based in part on the work of the independent jpeg group"),
    ("curl", "stenberg", r"copyright (?:c )?(?:19|20)\d\d (?:\w+ ){0,4}daniel stenberg"),
    ("hpnd", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("w3c", "w3c", r"w3c software (?:notice|and document) (?:and )?licen[sc]e"),
    ("zpl", "zope", r"zope public licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("qpl", "q", r"q public licen[sc]e"),
    ("ipl", "ibm", r"ibm public licen[sc]e"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("freetype", "freetype", r"portions of this software are copyright .{1,30} the freetype project"),
    ("icu", "unicode", r"unicode (?:inc )?licen[sc]e agreement data files and software"),
    ("sspl", "server", r"server side public licen[sc]e"),
    ("busl", "business", r"business source licen[sc]e"),
    ("elastic", "elastic", r"(?:licensed under the )?elastic licen[sc]e(?: 2 0| v2)?"),
    ("cpal", "attribution", r"common public attribution licen[sc]e"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("apache-2.0", "apache", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("bsd", "regents", r"regents of the university of california all rights reserved"),
    ("gpl", "copying", r"see (?:the )?(?:file )?copying for (?:licen[sc]e )?details"),
    ("gpl", "copying", r"this is free software see the source for copying conditions"),
    ("lgpl", "linking", r"as a special exception .{1,80} linking"),
    ("gfdl", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("cc-by-sa", "sharealike|alike", r"text is available under the creative commons attribution share ?alike licen[sc]e"),
    ("cc-by", "unrestricted", r"distributed under the creative commons attribution licen[sc]e which permits unrestricted use"),
    ("pddl", "dedication", r"public domain dedication and licen[sc]e"),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e"),
    ("etalab", "ouverte|etalab", r"licence ouverte(?: v?[12](?: 0)?)?(?: etalab)?|etalab open licen[sc]e"),
    ("dl-de", "datenlizenz", r"datenlizenz deutschland(?: namensnennung)?"),
    ("openrail", "rail|openrail", r"open ?rail(?: m)?(?: licen[sc]e)?|responsible ai licenses rail"),
    ("llama", "llama", r"llama (?:\d (?:\d )?)?community licen[sc]e"),
    ("proprietary", "consent|approval", r"(?:shall|may|must) not be (?:disclosed|copied|used) (?:in whole or in part )?(?:to third parties )?without (?:the )?prior written (?:consent|approval)"),
    ("proprietary", "internal", r"for internal use only"),
    ("proprietary", "redistribution", r"redistribution (?:is )?(?:strictly )?(?:prohibited|forbidden|not permitted)"),
    ("reserved", "reservados", r"(?:todos los derechos|direitos|todos os direitos) reservados"),
    ("proprietary", "reproduction", r"toute reproduction (?:meme partielle )?(?:est )?interdite"),
    ("proprietary", "prohibida", r"prohibida (?:la|su) reproduccion(?: total o parcial)?"),
    ("proprietary", "vervielfaltigung", r"vervielfaltigung (?:ist )?(?:nicht gestattet|untersagt|verboten)"),
    ("copyright", "copr", r"copr (?:19|20)\d\d"),
    ("copyright", "copyrighted", r"this (?:work|material|text|article) is copyrighted"),
    ("no-ai", "training", r"may not be used (?:for|in) (?:the )?training (?:of )?(?:artificial intelligence|machine learning|language models?)"),
    ("no-ai", "mining", r"text and data mining (?:is|are) (?:not permitted|prohibited|reserved)"),
)

#: Short names of the SPDX list and their labels; fixed values.
SPDX = (
    ("mit", "MIT X11-distribute-modifications-variant"), ("mit-0", "MIT-0"), ("0bsd", "0BSD"), ("isc", "ISC"), ("x11", "X11"), ("ncsa", "NCSA"), ("zlib", "Zlib zlib-acknowledgement"), ("boost", "BSL-1.0"),
    ("apache", "Apache-1.0"), ("apache-1.1", "Apache-1.1"), ("apache-2.0", "Apache-2.0"),
    ("bsd-2-clause", "BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views"), ("bsd-3-clause", "BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL"), ("bsd-4-clause", "BSD-4-Clause BSD-4-Clause-UC"), ("bsd", "BSD-1-Clause BSD-Source-Code"),
    ("gpl", "GPL-1.0 GPL-1.0-only GPL-1.0-or-later"), ("gpl-2.0", "GPL-2.0 GPL-2.0-only GPL-2.0-or-later"), ("gpl-3.0", "GPL-3.0 GPL-3.0-only GPL-3.0-or-later"),
    ("lgpl", "LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later"), ("agpl", "AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"), ("gfdl", "GFDL-1.1 GFDL-1.2 GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later"),
    ("mpl", "MPL-1.0 MPL-1.1"), ("mpl-2.0", "MPL-2.0 MPL-2.0-no-copyleft-exception"), ("epl", "EPL-1.0 EPL-2.0"), ("cddl", "CDDL-1.0 CDDL-1.1"), ("cpl", "CPL-1.0"), ("cpal", "CPAL-1.0"), ("eupl", "EUPL-1.0 EUPL-1.1 EUPL-1.2"), ("ipl", "IPL-1.0"), ("qpl", "QPL-1.0"),
    ("artistic", "Artistic-1.0 Artistic-1.0-Perl Artistic-2.0"), ("python", "PSF-2.0 Python-2.0"), ("postgresql", "PostgreSQL"), ("openssl", "OpenSSL"), ("php", "PHP-3.0 PHP-3.01"), ("ruby", "Ruby"), ("wtfpl", "WTFPL"), ("unlicense", "Unlicense"),
    ("cc0", "CC0-1.0"), ("cc-by", "CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0"), ("cc-by-nc", "CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0"), ("cc-by-nd", "CC-BY-ND-3.0 CC-BY-ND-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0"), ("cc-by-nc-nd", "CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0"),
    ("ogl", "OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0"), ("odbl", "ODbL-1.0"), ("odc-by", "ODC-By-1.0"), ("pddl", "PDDL-1.0"), ("ofl", "OFL-1.0 OFL-1.1"), ("ms-pl", "MS-PL MS-RL"), ("etalab", "etalab-2.0"),
    ("upl", "UPL-1.0"), ("ecl", "ECL-1.0 ECL-2.0"), ("afl", "AFL-2.1 AFL-3.0"), ("osl", "OSL-2.1 OSL-3.0"), ("cecill", "CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C"), ("lppl", "LPPL-1.3a LPPL-1.3c"), ("mulan", "MulanPSL-1.0 MulanPSL-2.0"), ("vim", "Vim"), ("beerware", "Beerware"), ("ijg", "IJG"), ("curl", "curl"),
    ("hpnd", "HPND"), ("w3c", "W3C W3C-20150513"), ("zpl", "ZPL-2.0 ZPL-2.1"), ("sleepycat", "Sleepycat"), ("json", "JSON"), ("freetype", "FTL"), ("icu", "ICU Unicode-3.0"), ("sspl", "SSPL-1.0"), ("busl", "BUSL-1.1"), ("elastic", "Elastic-2.0"), ("blueoak", "BlueOak-1.0.0"),
)

#: Ways to state a licence: prefix, suffix, keyword, added priority, confidence. A rule is a name in
#: one of these ways.
WAYS = (
    (r"(?:is |are |been )?(?:re)?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?", r"", ("licensed", "licenced", "relicensed", "relicenced"), 40, 0.99),
    (r"(?:released|distributed|published|provided|available|made available) under (?:the )?(?:terms of (?:the )?)?", r"", ("under",), 40, 0.97),
    (r"(?:spdx )?licen[sc]e identifier ", r"", ("identifier",), 50, 1.0),
    (r"(?:subject to|governed by|in accordance with|under) (?:the )?(?:terms of (?:the )?)?", r"", ("subject", "governed", "accordance", "under"), 30, 0.9),
    (r"licen[sc]e ", r"", ("license", "licence"), 20, 0.8),
    (r"", r" (?:applies|terms|agreement|notice|text)", ("applies", "terms", "agreement", "notice", "text"), 15, 0.7),
    (r"", r"", (), 10, 0.6),
)


@dataclass(frozen=True)
class Rule:
    label: str
    need: tuple[str, ...]  # one of these keywords
    any_of: tuple[str, ...]  # and one of these, if there are any
    priority: int
    confidence: float
    regex: re.Pattern


def sentences() -> tuple[Rule, ...]:
    """The written signature rules; earlier ones win ties of priority."""
    return tuple(Rule(label, tuple(keys.split("|")), (), 6000 + len(SENTENCES) - k, 0.95, re.compile(rf"(?<![^ ])(?:{text})(?![^ ])")) for k, (label, keys, text) in enumerate(SENTENCES))


def spdx() -> tuple[Rule, ...]:
    """Short names after a licence identifier tag, and further ones in an expression after it."""
    tag = r"(?<![^ ])(?:spdx )?licen[sc]e identifier "
    names = [(label, " ".join(re.findall("[a-z0-9]+", x.lower()))) for label, xs in SPDX for x in xs.split()]
    forms = (tag + r"{}(?![^ ])", tag + r"(?:[a-z0-9]+ ){{1,9}}?(?P<at>(?:or|and) {})(?![^ ])")
    return tuple(Rule(label, ("identifier",), (name.split()[0],), 8000, 1.0, re.compile(form.format(name))) for label, name in names for form in forms)


def folded(word: str) -> str:
    """A word in lower case without accents, as the method's rules are written."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


def rules() -> tuple[Rule, ...]:
    """Every name in every way, most specific names first (their order breaks ties of priority), the written
    sentences, the short names, and two notices."""
    made = [Rule(label, tuple(keys.split("|")), any_of, add * 100 + len(NAMES) - k, conf, re.compile(rf"(?<![^ ])(?:{pre}(?:{name}){post})(?![^ ])")) for k, (label, keys, name) in enumerate(NAMES) for pre, post, any_of, add, conf in WAYS]
    made += sentences()
    made += spdx()
    made.append(Rule("copyright", ("copyright",), (), 500, 0.5, re.compile(r"(?<![^ ])copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?(?! [^ ]*licen)")))
    made.append(Rule("no-warranty", ("without",), (), 400, 0.5, re.compile(r"(?<![^ ])without (?:any )?warranty(?: of any kind)?")))
    return tuple(made)


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drops detections that lie inside one of higher priority, or of equal priority and greater length.

    In order of priority, each looks up how far detections before it that start no later reach: the
    greatest end over a prefix of the starts, kept in a tree of partial maxima."""
    starts = {a: k + 1 for k, a in enumerate(sorted({a for a, _, _ in found}))}
    reach = [-1] * (len(starts) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for a, b, r in sorted(set(found), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)):
        k, far = starts[a], -1
        while k:
            far = max(far, reach[k])
            k &= k - 1
        if far >= b:
            continue
        kept.append((a, b, r))
        k = starts[a]
        while k < len(reach):
            reach[k] = max(reach[k], b)
            k += k & -k
    return sorted(kept, key=lambda x: (x[0], x[1]))


def scan_words(words: list[str], by_key: dict[str, list[Rule]]) -> list[tuple[int, int, Rule]]:
    """Resolved detections (first word, word after the last, rule)."""
    text, there, found = " ".join(words), set(words), []
    at = list(accumulate((len(w) + 1 for w in words), initial=0))  # where each word begins
    for r in {r for key in there & by_key.keys() for r in by_key[key]}:
        if not r.any_of or any(x in there for x in r.any_of):
            for m in r.regex.finditer(text):
                start, end = m.span("at" if r.regex.groupindex else 0)
                found.append((bisect_right(at, start) - 1, bisect_left(at, end), r))
    return resolve(found)


def keyed(made: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by each of their keywords."""
    by_key: dict[str, list[Rule]] = {}
    for r in made:
        for key in r.need:
            by_key.setdefault(key, []).append(r)
    return by_key


def _phrases(codes: np.ndarray, doc: np.ndarray, names: dict[bytes, int], phrase: str) -> np.ndarray:
    """Word positions where the phrase's words stand consecutively in one document."""
    want = [names.get(x.encode(), -1) for x in phrase.split()]
    if min(want) < 0 or len(codes) < len(want):
        return np.zeros(0, np.int64)
    n = len(codes) - len(want) + 1
    ok = doc[:n] == doc[len(want) - 1 :]
    for k, c in enumerate(want):
        ok &= codes[k : n + k] == c
    return np.flatnonzero(ok)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long,confidence:double>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text), with all kept detections; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = keyed(rules())
        gates = by_key.keys()
        for batch in batches:
            for p in tk.pieces(batch):
                w = tk.Words(p, tk.ALNUM, lower=True)
                codes, dictionary = w.encode()
                listed = dictionary.to_pylist()
                names = {x: i for i, x in enumerate(listed)}
                doc, first, n = w.doc, w.first, len(p)
                base = [np.zeros(0, np.int64)]
                labels: list[set] = [set() for _ in range(n)]
                for phrase, label in BASE:
                    base.append(at := _phrases(codes, doc, names, phrase))
                    for d in np.unique(doc[at]).tolist():
                        labels[d].add(label)
                at = np.sort(np.concatenate(base))
                lo, hi = np.searchsorted(at, first[:-1]), np.searchsorted(at, first[1:])
                n_base = hi - lo
                has = n_base > 0
                first_word = np.where(has, at[np.minimum(lo, max(len(at) - 1, 0))] - first[:-1] if len(at) else 0, 0)
                last_word = np.where(has, at[np.maximum(hi - 1, 0)] - first[:-1] if len(at) else 0, 0)
                plain = [folded(x.decode()) for x in listed]
                gate = np.fromiter((x in gates for x in plain), bool, len(plain))
                all_labels = [set(x) for x in labels]
                score = np.where(has, 0.6, 0.0)
                spans: list[list] = [[] for _ in range(n)]
                for d in np.unique(doc[gate[codes]]).tolist() if len(codes) else []:
                    text = [plain[c] for c in codes[first[d] : first[d + 1]].tolist()]
                    for a, b, r in scan_words(text, by_key):
                        all_labels[d].add(r.label)
                        score[d] = max(score[d], r.confidence)
                        spans[d].append({"label": r.label, "start": a, "end": b, "confidence": r.confidence})
                kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [p.rows.column(0), pa.array(w.counts, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first_word, pa.int64(), mask=~has), pa.array(last_word, pa.int64(), mask=~has)]
                    + [pa.array([",".join(sorted(x)) for x in s], pa.string()) for s in (labels, all_labels)]
                    + [pa.array(score, pa.float64()), pa.array(spans, kind)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
