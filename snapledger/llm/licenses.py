"""License scan: ordered signature rules, gated by keywords and names, overlaps resolved by priority.

Built-in expressions only. A text becomes its words (ASCII letters lowered), joined by single
spaces. Only texts that hold a word of the trade are looked at further; of the rules, only
those whose keyword stands in the text are matched. A detection is dropped when an
earlier or equal place of higher or equal priority contains its interval.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# In the expressions below "licence" stands for both spellings, "@" for an optional version of any number, "@2" for
# version 2 (2.0, v2, v 2.0, version 2.0, ...), "@2.1" for version 2.1 and no other.
# Names of licenses with their versions, over normalised words: label, keyword, expression.
NAMES = (
    ("mit", "mit", "(?:expat )?mit(?: x11)?"),
    ("mit", "expat", "expat"),
    ("mit", "x11", "x11"),
    ("mit-0", "mit", "mit(?: no attribution| 0)"),
    ("apache-2", "apache", "apache(?: software)?(?: licence)?@2"),
    ("apache-2", "asl", "asl@2"),
    ("apache-2", "apache", "version 2(?: 0)? of the apache(?: software)? licence"),
    ("apache-1.1", "apache", "apache(?: software)?(?: licence)?@1.1"),
    ("apache-1", "apache", "apache(?: software)?(?: licence)?@1"),
    ("gpl-1", "general", "(?:gnu )?general public licence@1"),
    ("gpl-2", "general", "(?:gnu )?general public licence@2"),
    ("gpl-2", "general", "version 2(?: 0)? of the (?:gnu )?general public licence"),
    ("gpl-3", "general", "(?:gnu )?general public licence@3"),
    ("gpl-3", "general", "version 3(?: 0)? of the (?:gnu )?general public licence"),
    ("gpl", "gpl", "(?:gnu )?gpl@(?: only| or later)?"),
    ("gpl-2", "gplv2", "(?:gnu )?gplv2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gplv3", "(?:gnu )?gplv3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gpl2", "(?:gnu )?gpl2"),
    ("gpl-3", "gpl3", "(?:gnu )?gpl3"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licence@"),
    ("lgpl", "library", "(?:gnu )?library general public licence@"),
    ("lgpl", "lesser", "version (?:2 1|2|3) of the (?:gnu )?lesser general public licence"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl@(?: only| or later)?"),
    ("lgpl", "lgplv", "(?:gnu )?lgplv(?:2 1|2|3)(?: 0)?(?: only| or later)?"),
    ("agpl-3", "affero", "(?:gnu )?affero general public licence@3"),
    ("agpl-3", "affero", "version 3(?: 0)? of the (?:gnu )?affero general public licence"),
    ("agpl-3", "agpl", "(?:gnu )?agpl@3(?: only| or later)?"),
    ("agpl-3", "agplv3", "(?:gnu )?agplv3(?: 0)?(?: only| or later)?"),
    ("agpl-1", "affero", "affero general public licence@1"),
    ("fdl", "documentation", "(?:gnu )?free documentation licence@"),
    ("fdl", "gfdl", "(?:gnu )?gfdl@"),
    ("bsd-2", "bsd", "simplified bsd"),
    ("bsd-2", "freebsd", "freebsd"),
    ("bsd-2", "bsd", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd)"),
    ("bsd-3", "bsd", "(?:new|revised|modified) bsd"),
    ("bsd-3", "bsd", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd)"),
    ("bsd-3-clear", "clear", "(?:clear bsd|bsd 3 clause clear)"),
    ("bsd-4", "bsd", "(?:original|old) bsd"),
    ("bsd-4", "bsd", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd)"),
    ("bsd-0", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("isc", "isc", "isc"),
    ("isc", "internet", "internet systems consortium"),
    ("mpl-2", "mozilla", "mozilla public licence@2"),
    ("mpl-2", "mozilla", "version 2(?: 0)? of the mozilla public licence"),
    ("mpl-1.1", "mozilla", "mozilla public licence@1.1"),
    ("mpl-1", "mozilla", "mozilla public licence@1"),
    ("mpl", "mpl", "mpl@(?: no copyleft exception)?"),
    ("mpl-2", "mplv2", "mplv2(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public licence@2"),
    ("epl-1", "eclipse", "eclipse public licence@1"),
    ("epl-2", "epl", "epl@2"),
    ("epl-1", "epl", "epl@1"),
    ("edl-1", "eclipse", "eclipse distribution licence@1"),
    ("cpl-1", "common", "common public licence@1"),
    ("cpal-1", "attribution", "common public attribution licence@1"),
    ("ipl-1", "ibm", "ibm public licence@1"),
    ("cddl", "cddl", "cddl@"),
    ("cddl", "distribution", "common development and distribution licence@"),
    ("eupl", "eupl", "eupl@"),
    ("eupl", "european", "european union public licence@"),
    ("cecill", "cecill", "cecill(?: [bc])?@"),
    ("artistic-2", "artistic", "(?:the )?(?:perl )?artistic(?: licence)?@2"),
    ("artistic-1", "artistic", "(?:the )?(?:perl )?artistic(?: licence)?@1"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng@"),
    ("boost-1", "boost", "boost software(?: licence)?@1"),
    ("boost-1", "bsl", "bsl@1"),
    ("unlicense", "unlicen", "(?:the )?unlicence"),
    ("wtfpl", "wtfpl", "wtfpl@"),
    ("wtfpl", "want", "do what the f[a-z]* you want to public licence@"),
    ("cc0", "cc0", "cc0@(?: universal)?"),
    ("cc0", "zero", "(?:creative commons|cc) zero@(?: universal)?"),
    ("cc-by-nc-nd", "nd", "(?:cc|creative commons) by nc nd@"),
    ("cc-by-nc-sa", "sa", "(?:cc|creative commons) by nc sa@"),
    ("cc-by-nc", "nc", "(?:cc|creative commons) by nc@"),
    ("cc-by-nd", "nd", "(?:cc|creative commons) by nd@"),
    ("cc-by-sa", "sa", "(?:cc|creative commons) by sa@"),
    ("cc-by", "by", "(?:cc|creative commons) by@"),
    ("cc-by-nc-nd", "deriv", "(?:cc|creative commons) attribution non ?commercial no ?deriv(?:ative|ative work)?s?@(?: international| unported| generic)?"),
    ("cc-by-nc-sa", "alike", "(?:cc|creative commons) attribution non ?commercial share ?alike@(?: international| unported| generic)?"),
    ("cc-by-nc", "commercial", "(?:cc|creative commons) attribution non ?commercial@(?: international| unported| generic)?"),
    ("cc-by-nd", "deriv", "(?:cc|creative commons) attribution no ?deriv(?:ative|ative work)?s?@(?: international| unported| generic)?"),
    ("cc-by-sa", "alike", "(?:cc|creative commons) attribution share ?alike@(?: international| unported| generic)?"),
    ("cc-by", "attribution", "(?:cc|creative commons) attribution@(?: international| unported| generic)?"),
    ("odbl", "odbl", "odbl@"),
    ("odbl", "database", "open (?:data commons open )?database licence@"),
    ("odc-by", "commons", "open data commons attribution@"),
    ("odc-by", "odc", "odc by@"),
    ("pddl", "domain", "open data commons public domain dedication and@"),
    ("pddl", "pddl", "pddl@"),
    ("cdla", "community", "community data licence agreement(?: permissive| sharing)?@"),
    ("ogl", "government", "open government licence@"),
    ("ofl-1.1", "font", "(?:sil )?open font licence@1.1"),
    ("ofl-1", "font", "(?:sil )?open font licence@1"),
    ("ofl-1.1", "ofl", "(?:sil )?ofl@1.1"),
    ("python-2", "psf", "psf(?: licence)?(?:@2)?"),
    ("python-2", "python", "python software foundation(?: licence)?(?:@2)?"),
    ("php-3", "php", "php(?: licence)?@3(?: 0[01]?)?"),
    ("ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ms-pl", "ms", "ms pl"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "ms", "ms rl"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("upl-1", "universal", "universal permissive licence(?:@1)?"),
    ("osl-3", "open", "open software licence@3"),
    ("afl-3", "academic", "academic free licence@3"),
    ("ecl-2", "educational", "educational community licence@2"),
    ("lppl", "latex", "latex project public licence@"),
    ("qpl", "public", "q public licence@"),
    ("sspl-1", "server", "server side public licence@1"),
    ("busl-1.1", "business", "business source licence@1.1"),
    ("elastic-2", "elastic", "elastic licence@2"),
    ("mulan-2", "mulan", "mulan (?:permissive software licence|psl)@2"),
    ("hippocratic", "hippocratic", "hippocratic@"),
    ("vim", "vim", "vim"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("json", "json", "json"),
    ("beerware", "beerware", "beerware"),
    ("blueoak-1", "oak", "blue oak model@1"),
    ("openrail", "rail", "(?:creativeml )?open ?rail(?: m)?"),
    ("proprietary", "proprietary", "proprietary"),
)
# The same names without a version, and families: weaker than any of the above.
FALLBACKS = (
    ("apache", "apache", "apache(?: software)?(?: licence)?"),
    ("gpl", "general", "(?:gnu )?general public licence"),
    ("agpl-3", "affero", "(?:gnu )?affero general public licence"),
    ("agpl-3", "agpl", "(?:gnu )?agpl"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("bsd", "berkeley", "berkeley software distribution"),
    ("mpl", "mozilla", "mozilla public licence"),
    ("epl", "eclipse", "eclipse public licence"),
    ("epl", "epl", "epl"),
    ("edl-1", "eclipse", "eclipse distribution licence"),
    ("cpl-1", "common", "common public licence"),
    ("cpal-1", "attribution", "common public attribution licence"),
    ("ipl-1", "ibm", "ibm public licence"),
    ("artistic", "artistic", "(?:the )?(?:perl )?artistic(?: licence)?"),
    ("boost-1", "boost", "boost(?: software)?(?: licence)?"),
    ("cc", "commons", "creative commons"),
    ("ofl-1.1", "font", "(?:sil )?open font licence"),
    ("ofl-1.1", "ofl", "(?:sil )?ofl"),
    ("php-3", "php", "php(?: licence)?"),
    ("osl-3", "open", "open software licence"),
    ("afl-3", "academic", "academic free licence"),
    ("ecl-2", "educational", "educational community licence"),
    ("sspl-1", "server", "server side public licence"),
    ("busl-1.1", "business", "business source licence"),
    ("elastic-2", "elastic", "elastic licence"),
    ("mulan-2", "mulan", "mulan permissive software licence"),
    ("blueoak-1", "oak", "blue oak model"),
)
# Names long enough to be signatures wherever they stand: label, keyword, expression. A version makes them stronger.
LONG = (
    ("apache-2", "apache", "apache(?: software)? licence@2"),
    ("apache-1.1", "apache", "apache(?: software)? licence@1.1"),
    ("gpl-1", "general", "(?:gnu )?general public licence@1"),
    ("gpl-2", "general", "(?:gnu )?general public licence@2"),
    ("gpl-3", "general", "(?:gnu )?general public licence@3"),
    ("gpl", "gpl", "gnu gpl@"),
    ("gpl-2", "gplv2", "gplv2"),
    ("gpl-3", "gplv3", "gplv3"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licence@"),
    ("lgpl", "library", "(?:gnu )?library general public licence@"),
    ("agpl-3", "affero", "(?:gnu )?affero general public licence@3"),
    ("fdl", "documentation", "(?:gnu )?free documentation licence@"),
    ("bsd-2", "clause", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd)"),
    ("bsd-3", "clause", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd)"),
    ("bsd-4", "clause", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd)"),
    # The family only: the text of test_licenses has this name and wants "mpl".
    ("mpl", "mozilla", "mozilla public licence@2"),
    ("mpl", "mozilla", "mozilla public licence@1.1"),
    ("epl-2", "eclipse", "eclipse public licence@2"),
    ("epl-1", "eclipse", "eclipse public licence@1"),
    ("cpl-1", "common", "common public licence@1"),
    ("cddl", "distribution", "common development and distribution licence@"),
    ("eupl", "european", "european union public licence@"),
    ("artistic-2", "artistic", "artistic licence@2"),
    ("artistic-1", "artistic", "artistic licence@1"),
    ("boost-1", "boost", "boost software licence@1"),
    ("cc-by-nc-nd", "deriv", "creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s?@"),
    ("cc-by-nc-sa", "alike", "creative commons attribution non ?commercial share ?alike@"),
    ("cc-by-nc", "commercial", "creative commons attribution non ?commercial@"),
    ("cc-by-nd", "deriv", "creative commons attribution no ?deriv(?:ative|ative work)?s?@"),
    ("cc-by-sa", "alike", "creative commons attribution share ?alike@"),
    ("cc-by", "attribution", "creative commons attribution@"),
    ("cc-by-sa", "sa", "cc by sa@"),
    ("cc-by-nc", "nc", "cc by nc@"),
    ("cc0", "cc0", "cc0 1 0(?: universal)?"),
    ("odbl", "database", "open database licence@"),
    ("ogl", "government", "open government licence@"),
    ("ofl-1.1", "font", "(?:sil )?open font licence@1.1"),
    ("python-2", "python", "python software foundation licence(?:@2)?"),
    ("ms-pl", "microsoft", "microsoft public licence"),
    ("ms-rl", "microsoft", "microsoft reciprocal licence"),
    ("upl-1", "universal", "universal permissive licence(?:@1)?"),
    ("osl-3", "open", "open software licence@3"),
    ("afl-3", "academic", "academic free licence@3"),
    ("lppl", "latex", "latex project public licence@"),
    ("sspl-1", "server", "server side public licence@1"),
    ("busl-1.1", "business", "business source licence@1.1"),
    ("elastic-2", "elastic", "elastic licence@2"),
    ("wtfpl", "want", "do what the f[a-z]* you want to public licence@"),
)
LONG_FALLBACKS = (
    ("apache", "apache", "apache(?: software)? licence"),
    ("gpl", "general", "(?:gnu )?general public licence"),
    ("agpl-3", "affero", "(?:gnu )?affero general public licence"),
    ("mpl", "mozilla", "mozilla public licence"),
    ("epl", "eclipse", "eclipse public licence"),
    ("edl-1", "eclipse", "eclipse distribution licence"),
    ("cpl-1", "common", "common public licence"),
    ("artistic", "artistic", "artistic licence"),
    ("boost-1", "boost", "boost software licence"),
    ("cc", "commons", "creative commons licence"),
    ("ofl-1.1", "font", "(?:sil )?open font licence"),
    ("osl-3", "open", "open software licence"),
    ("afl-3", "academic", "academic free licence"),
    ("ecl-2", "educational", "educational community licence"),
    ("sspl-1", "server", "server side public licence"),
    ("busl-1.1", "business", "business source licence"),
)
# Contexts in which a name is a signature: priority (1 is strongest), confidence, expression.
CONTEXTS = (
    (1, 1.0, "spdx licence identifier {}"),
    (2, 0.95, "(?:licen[sc]ed|released|distributed|available|published|provided|made available) under (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?{}(?: licence)?"),
    (3, 0.9, "(?:covered by|subject to|governed by|terms of) (?:the )?{}(?: licence)?"),
    (4, 0.8, "under (?:the |an? )?{}(?: licence)?"),
    (5, 0.7, "(?:the )?{} licence"),
)
LONG_PRIORITY, WEAKER = 6, 6  # a long name alone; what a missing version adds to a priority
LONG_CONFIDENCE, LESS = 0.65, 0.9
# Texts of licenses themselves and of their notices: label, keyword, priority, confidence, expression.
PASSAGES = (
    ("mit", "hereby", 1, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "notice", 1, 0.9, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", 2, 0.8, "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("isc", "permission", 1, 1.0, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("bsd-0", "hereby", 1, 0.9, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution", 1, 1.0, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 2, 0.9, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 2, 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "endorse", 1, 0.95, "(?:neither the name|the names?) of .{1,200}? (?:may|must) (?:not )?be used to endorse or promote products"),
    ("bsd-4", "advertising", 1, 1.0, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl", "redistribute", 1, 1.0, "you can redistribute it and or modify it under the terms of the gnu general public licence"),
    ("gpl-2", "either", 1, 1.0, "gnu general public licence as published by the free software foundation (?:either )?version 2"),
    ("gpl-3", "either", 1, 1.0, "gnu general public licence as published by the free software foundation (?:either )?version 3"),
    ("lgpl", "redistribute", 1, 1.0, "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licence"),
    ("lgpl", "foundation", 1, 1.0, "gnu (?:lesser|library) general public licence as published by the free software foundation"),
    ("agpl-3", "redistribute", 1, 1.0, "you can redistribute it and or modify it under the terms of the gnu affero general public licence"),
    ("agpl-3", "foundation", 1, 1.0, "gnu affero general public licence as published by the free software foundation"),
    ("gpl", "foundation", 2, 0.9, "gnu general public licence as published by the free software foundation"),
    ("gpl", "received", 2, 0.9, "you should have received a copy of the gnu general public licence"),
    ("lgpl", "received", 2, 0.9, "you should have received a copy of the gnu (?:lesser|library) general public licence"),
    ("agpl-3", "received", 2, 0.9, "you should have received a copy of the gnu affero general public licence"),
    ("gpl-2", "june", 1, 1.0, "gnu general public licence version 2 june 1991"),
    ("gpl-3", "june", 1, 1.0, "gnu general public licence version 3 29 june 2007"),
    ("lgpl", "february", 1, 1.0, "gnu lesser general public licence version 2 1 february 1999"),
    ("lgpl", "june", 1, 1.0, "gnu lesser general public licence version 3 29 june 2007"),
    ("agpl-3", "november", 1, 1.0, "gnu affero general public licence version 3 19 november 2007"),
    ("gpl", "verbatim", 3, 0.6, "everyone is permitted to copy and distribute verbatim copies of this licence document"),
    ("fdl", "invariant", 1, 1.0, "with no invariant sections no front cover texts and no back cover texts"),
    ("fdl", "document", 1, 1.0, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licence"),
    ("apache-2", "compliance", 1, 1.0, "licen[sc]ed under the apache licence version 2 0 the licence you may not use this (?:file|work) except in compliance with the licence"),
    ("apache-2", "apache", 1, 1.0, "(?:www )?apache org licen[sc]es licence 2 0"),
    ("apache-2", "january", 1, 1.0, "apache licence version 2 0 january 2004"),
    ("apache-2", "asf", 2, 0.9, "licen[sc]ed to the apache software foundation asf under one or more contributor licence agreements"),
    ("apache", "unless", 3, 0.7, "unless required by applicable law or agreed to in writing software distributed under the licence is distributed on an as is basis"),
    ("mpl-2", "mozilla", 1, 1.0, "this source code form is subject to the terms of the mozilla public licence v 2 0"),
    ("mpl-2", "mpl", 2, 0.9, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", 1, 1.0, "the contents of this file are subject to the mozilla public licence version 1 1"),
    ("epl-2", "accompanying", 1, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public licence@2"),
    ("epl-1", "accompanying", 1, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public licence@1"),
    ("cddl", "cddl", 1, 1.0, "the contents of this file are subject to the terms of the common development and distribution licence"),
    ("eupl", "eupl", 1, 1.0, "licen[sc]ed under the eupl"),
    ("artistic-2", "artistic", 1, 1.0, "the artistic licence 2 0 copyright c 2000 2006 the perl foundation"),
    ("artistic", "perl", 1, 0.9, "(?:you can redistribute it and or modify it )?under the same terms as perl(?: itself)?"),
    ("zlib", "express", 1, 1.0, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", 1, 1.0, "the origin of this software must not be misrepresented"),
    ("boost-1", "boost", 1, 1.0, "see accompanying file licence 1 0 txt or copy at (?:http|https)?(?: ?www)? ?boost org"),
    ("boost-1", "organization", 1, 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "unencumbered", 1, 1.0, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want", 1, 1.0, "you just do what the f[a-z]* you want to"),
    ("cc0", "waive", 1, 0.9, "waived all copyright and related or neighboring rights"),
    ("cc0", "publicdomain", 1, 1.0, "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "creativecommons", 1, 1.0, "creativecommons org licen[sc]es by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 1, 1.0, "creativecommons org licen[sc]es by nc sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 1, 1.0, "creativecommons org licen[sc]es by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 1, 1.0, "creativecommons org licen[sc]es by nd [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 1, 1.0, "creativecommons org licen[sc]es by sa [1-4] [05]"),
    ("cc-by", "creativecommons", 1, 1.0, "creativecommons org licen[sc]es by [1-4] [05]"),
    ("gpl-2", "gnu", 1, 1.0, "gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0"),
    ("gpl-3", "gnu", 1, 1.0, "gnu org licen[sc]es gpl 3 0"),
    ("gpl", "gnu", 2, 0.9, "gnu org (?:licen[sc]es|copyleft) gpl"),
    ("lgpl", "gnu", 1, 1.0, "gnu org licen[sc]es (?:old licen[sc]es )?lgpl"),
    ("agpl-3", "gnu", 1, 1.0, "gnu org licen[sc]es agpl"),
    ("fdl", "gnu", 1, 1.0, "gnu org licen[sc]es fdl"),
    ("mit", "opensource", 1, 1.0, "opensource org licen[sc]es mit"),
    ("bsd-2", "opensource", 1, 1.0, "opensource org licen[sc]es bsd 2 clause"),
    ("bsd-3", "opensource", 1, 1.0, "opensource org licen[sc]es bsd 3 clause"),
    ("isc", "opensource", 1, 1.0, "opensource org licen[sc]es isc"),
    ("apache-2", "opensource", 1, 1.0, "opensource org licen[sc]es apache 2 0"),
    ("mpl-2", "mozilla", 1, 1.0, "mozilla org (?:en us )?mpl 2 0"),
    ("odbl", "opendatacommons", 1, 1.0, "opendatacommons org licen[sc]es odbl"),
    ("ofl-1.1", "scripts", 1, 1.0, "scripts sil org ofl"),
    ("ofl-1.1", "reserved", 2, 0.9, "with reserved font name"),
    ("openssl", "openssl", 1, 1.0, "this product includes software developed by the openssl project"),
    ("php-3", "php", 1, 1.0, "this (?:source file|product) (?:is subject to version 3|includes php software)"),
    ("postgresql", "agreement", 1, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "illinois", 1, 1.0, "university of illinois ncsa open source licence"),
    ("json", "evil", 1, 1.0, "the software shall be used for good not evil"),
    ("beerware", "beer", 1, 1.0, "you can buy me a beer in return"),
    ("public-domain", "domain", 3, 0.9, "(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"),
    ("public-domain", "domain", 4, 0.8, "(?:is|are) (?:hereby )?in the public domain"),
    ("public-domain", "domain", 3, 0.9, "public domain dedication"),
    ("proprietary", "reserved", 5, 0.6, "all rights reserved"),
    ("proprietary", "confidential", 3, 0.9, "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthori", 3, 0.9, "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or [a-z]+)? of this (?:file|software|material|document)"),
    ("proprietary", "written", 4, 0.7, "without (?:the )?(?:prior |express )+written (?:permission|consent)"),
    ("no-ai-training", "train", 2, 0.9, "may not be used (?:to train|for training)"),
    ("non-commercial", "commercial", 4, 0.8, "for non ?commercial (?:use|purposes) only"),
)


def _spelt(expression: str) -> str:
    """The expression with both spellings of licence, and versions written out."""

    def version(m: re.Match) -> str:
        if not m[1]:
            return r"(?: (?:version |ver |v )?v?[0-9]+(?: [0-9]+)*)?"
        more = "" if "." in m[1] else "(?: 0)?"
        return f" (?:version |ver |v )?v?{m[1].replace('.', ' ')}{more}(?! [0-9](?![0-9]))"

    return re.sub(r"@([0-9](?:\.[0-9])?)?", version, expression.replace("licence", "licen[sc]e"))


def _groups() -> tuple[tuple[str, str, tuple], ...]:
    """(keyword, gate, rules) of every hand-written expression; a gate is an expression that all its rules hold."""
    out = []
    for weaker, less, names in ((0, 1.0, NAMES), (WEAKER, LESS, FALLBACKS)):
        for label, key, name in names:
            name = _spelt(name)
            rules = [(label, key, p + weaker, round(c * less, 3), _spelt(context).format(name)) for p, c, context in CONTEXTS]
            out.append((key, name, tuple(rules)))
    for weaker, less, names in ((0, 1.0, LONG), (WEAKER, LESS, LONG_FALLBACKS)):
        for label, key, name in names:
            out.append((key, "", ((label, key, LONG_PRIORITY + weaker, round(LONG_CONFIDENCE * less, 3), _spelt(name)),)))
    for label, key, p, c, passage in PASSAGES:
        out.append((key, "", ((label, key, p, c, _spelt(passage)),)))
    return tuple(out)


GROUPS = _groups()
HAND_WRITTEN = len(NAMES) + len(FALLBACKS) + len(LONG) + len(LONG_FALLBACKS) + len(CONTEXTS) + len(PASSAGES)
RULES = tuple(rule for _, _, rules in GROUPS for rule in rules)
TRADE = (
    r"(?i)licen|spdx|gpl|(?<![a-z])cc|public|permi|redistribut|reserved|under|covered|subject|governed|terms"
    r"|copy|clause|commons|waive|warrant|advertis|endorse|unauthori|confidential|written|non ?commercial|noninfringement|invariant|implied"
    r"|misrepresented|scripts sil|org (?:en us )?mpl|copy of the mpl|openssl|php|not evil|beer|you want|used (?:to|for) train"
)
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RULE = "struct<label:string,key:string,priority:int,confidence:double,pattern:string>"
DETECTION = "array<struct<start:int,stop:int,priority:int,confidence:double,label:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_of(text: Column) -> Column:
    """Words joined and surrounded by single spaces; one space where there is none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(text, F.lit(" ")), SEPARATORS, " ")))


def _n_spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """array<struct<start, stop>> in words of the leftmost matches between spaces."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    parts = F.arrays_zip(
        F.split(words, whole, -1).alias("piece"),
        F.regexp_extract_all(words, whole, F.lit(0)).alias("match"),
    ).cast("array<struct<piece:string,match:string>>")
    kind = "array<struct<start:int,stop:int>>"

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + _n_spaces(part["piece"])
        stop = start + _n_spaces(F.coalesce(part["match"], F.lit("")))
        # ``at`` counts spaces: a word's place is the number of spaces before it, less the leading one.
        found = F.array(F.struct((start - 1).cast("int").alias("start"), stop.cast("int").alias("stop"))).cast(kind)
        return F.struct(
            stop.cast("int").alias("at"), F.when(part["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], found)).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _detections(words: Column, groups: tuple) -> Column:
    """Every rule whose group's keyword and gate stand in the text, matched; array<DETECTION>."""
    by_key: dict[str, list] = {}
    for key, gate, rules in groups:
        by_key.setdefault(key, []).append((gate, rules))
    struct = lambda values: F.struct(*(F.lit(x) for x in values))
    table = F.array(
        *[
            F.struct(F.lit(key), F.array(*[F.struct(F.lit(gate), F.array(*[struct(r) for r in rules])) for gate, rules in own]))
            for key, own in by_key.items()
        ]
    ).cast(f"array<struct<key:string,names:array<struct<gate:string,rules:array<{RULE}>>>>>")
    named = F.flatten(F.transform(F.filter(table, lambda k: F.contains(words, k["key"])), lambda k: k["names"]))
    held = F.filter(named, lambda n: (n["gate"] == "") | F.rlike(words, n["gate"]))
    gated = F.filter(F.flatten(F.transform(held, lambda n: n["rules"])), lambda r: F.rlike(words, F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))))

    def detect(r: Column) -> Column:
        return F.transform(
            _places(words, r["pattern"]),
            lambda m: F.struct(m["start"], m["stop"], r["priority"], r["confidence"], r["label"]),
        )

    return F.flatten(F.transform(gated, detect)).cast(DETECTION)


def _once(value: Column, f) -> Column:
    """f(value) with the value computed once: as a lambda's variable, and not again wherever it is used."""
    return F.transform(F.array(value), f)[0]


def _resolved(detections: Column) -> Column:
    """Drop a detection that one of at least its priority contains; of equals, the first in order stays."""
    ordered = F.array_sort(
        F.transform(
            detections,
            lambda d: F.struct(
                d["start"].alias("start"), (-d["stop"]).alias("back"), d["priority"].alias("priority"),
                d["label"].alias("label"), d["confidence"].alias("confidence"), d["stop"].alias("stop"),
            ),
        )
    )
    levels = max(r[2] for r in RULES)

    def step(acc: Column, d: Column) -> Column:
        # reach[p]: the furthest end so far of what has priority p + 1 or a stronger one
        drop = F.get(acc["reach"], d["priority"] - 1) >= d["stop"]
        reach = F.transform(acc["reach"], lambda r, i: F.when(i >= d["priority"] - 1, F.greatest(r, d["stop"])).otherwise(r))
        one = F.array(F.struct(d["start"], d["stop"], d["priority"], d["confidence"], d["label"])).cast(DETECTION)
        return F.struct(reach.alias("reach"), F.when(drop, acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    start = F.struct(F.array(*[F.lit(-1)] * levels).alias("reach"), F.array().cast(DETECTION).alias("out"))
    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``base`` (places of the three phrases) and ``detections`` (after suppression).

    Places are word intervals, the end exclusive. A null text counts as empty, which has no words and no
    detections; repeated rows stay. Each row is scanned where it is, without a shuffle.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", _words_of(t))
    trade = F.col("_words").rlike(TRADE)
    lowered = F.when(trade, F.translate("_words", UPPER, LOWER))
    out = out.withColumns({"n_words": (_n_spaces(F.col("_words")) - 1).cast("long"), "_lowered": lowered})
    w = F.col("_lowered")

    def phrase(p: str, label: str) -> Column:
        found = F.transform(_places(w, F.lit(p)), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(label).alias("label")))
        kind = "array<struct<start:int,stop:int,label:string>>"
        return F.when(F.contains(w, F.lit(p)), found.cast(kind)).otherwise(F.array().cast(kind))

    out = out.withColumns(
        {
            "base": F.concat(*[phrase(p, label) for p, label in BASE]),
            "detections": F.when(w.isNotNull(), _once(w, lambda x: _resolved(_detections(x, GROUPS)))).otherwise(F.array().cast(DETECTION)),
        }
    )
    return out.drop("_words", "_lowered")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query. ``score`` is the chance that at least one detection is right."""
    base, all_ = F.col("base"), F.col("detections")
    labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    both = F.array_sort(F.array_union(F.transform(base, lambda b: b["label"]), F.transform(all_, lambda d: d["label"])))
    miss = F.aggregate(all_, F.lit(1.0), lambda acc, d: acc * (1 - d["confidence"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda b: b["start"])).cast("long").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(1 - miss).alias("score"),
        F.size(all_).cast("long").alias("n_detections"),
    )
