"""Signature rules of licenses, written by hand, over texts as words in lower case between single spaces.

Each line: label, expression, a keyword that stands in every match, priority. Of detections that contain each other the
higher priority wins. Priorities: 6 an identifier, 5 a grant, 4 a sentence of the license's own text, 3 a reference to
its terms, 2 its name, 1 a short name that is telling alone.
"""

# Fixed values.
SIGNATURES = [
    # MIT, X11, Expat
    ("mit", "spdx license identifier mit", "identifier mit", 6),
    ("mit", "(?:licensed |released |distributed |available |published |provided )?under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?", " mit", 5),
    ("mit", "(?:licensed |released |distributed )?under (?:the )?(?:terms of (?:the )?)?(?:expat|x11) licen[sc]e", "under ", 5),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge to any person obtaining", 4),
    ("mit", "(?:terms|conditions|text|copy) of the mit(?: licen[sc]e)?", " of the mit", 3),
    ("mit", "licen[sc]e (?:is )?(?:the )?mit", " mit", 2),
    ("mit", "(?:mit|expat|x11) licen[sc]e[sd]?", " licen", 2),
    ("mit", "(?:dual|tri) licensed (?:under )?mit", "licensed", 5),
    ("mit-0", "(?:mit 0|mit no attribution)(?: licen[sc]e)?", "mit ", 3),
    # Apache
    ("apache-2", "spdx license identifier apache 2 0", "identifier apache", 6),
    ("apache-2", "(?:licensed |released |distributed |available |published |provided )?under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?", "apache", 5),
    ("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license", 4),
    ("apache-2", "you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0", "apache org licenses", 4),
    ("apache-2", "(?:terms|conditions|text|copy) of the apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?", " of the apache", 3),
    ("apache-2", "apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?(?: licen[sc]ed?)?", "apache", 2),
    ("apache-2", "asl ?2 0", "asl", 1),
    ("apache-1", "(?:licensed |released |distributed )?under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?1(?: [01])?", "apache", 5),
    ("apache-1", "apache(?: software)?(?: licen[sc]e)?(?: version)? v?1(?: [01])?", "apache", 2),
    ("apache-1", "this product includes software developed by the apache (?:group|software foundation)", "developed by the apache", 4),
    ("apache", "(?:licensed |released |distributed )?under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[sc]e", "apache", 5),
    ("apache", "apache(?: software)? licen[sc]ed?", "apache", 2),
    # BSD
    ("bsd-2", "spdx license identifier bsd 2 clause", "identifier bsd 2", 6),
    ("bsd-3", "spdx license identifier bsd 3 clause", "identifier bsd 3", 6),
    ("bsd-2", "under (?:the )?(?:terms of (?:the )?)?(?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause)(?: licen[sc]e)?", "bsd", 5),
    ("bsd-3", "under (?:the )?(?:terms of (?:the )?)?(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause)(?: licen[sc]e)?", "bsd", 5),
    ("bsd-4", "under (?:the )?(?:terms of (?:the )?)?(?:(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause)(?: licen[sc]e)?", "bsd", 5),
    ("bsd", "(?:licensed |released |distributed |available |published |provided )?under (?:an? |the )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[sc]e)?", "bsd", 5),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source", 4),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must", 4),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form must", 4),
    ("bsd-3", "neither the name of .{1,80}? (?:nor the names of its contributors )?may be used to endorse or promote products", "neither the name of", 4),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "all advertising materials mentioning", 4),
    ("bsd-2", "(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?", "bsd", 2),
    ("bsd-2", "bsd (?:2|two) clause(?: licen[sc]e)?", "bsd ", 2),
    ("bsd-3", "(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?", " bsd", 2),
    ("bsd-3", "bsd (?:3|three) clause(?: licen[sc]e)?", "bsd ", 2),
    ("bsd-4", "(?:original|4 clause|four clause) bsd(?: licen[sc]e)?", " bsd", 2),
    ("bsd", "bsd(?: style)? licen[sc]e[sd]?", "bsd", 2),
    ("bsd", "(?:terms|conditions|text|copy) of the bsd(?: licen[sc]e)?", " of the bsd", 3),
    ("bsd-0", "0bsd", "0bsd", 1),
    ("bsd-0", "(?:zero clause bsd|bsd zero clause)", "zero clause", 2),
    ("bsd-0", "free public licen[sc]e 1 0 0", "free public licen", 2),
    # GPL
    ("gpl-2", "spdx license identifier gpl 2 0(?: only| or later)?", "identifier gpl 2", 6),
    ("gpl-3", "spdx license identifier gpl 3 0(?: only| or later)?", "identifier gpl 3", 6),
    ("gpl-2", "under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? ?v?2(?: 0)?", "under ", 5),
    ("gpl-3", "under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? ?v?3(?: 0)?", "under ", 5),
    ("gpl", "under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl", "gpl", 5),
    ("gpl", "under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e", "general public licen", 5),
    ("gpl", "this program is free software you can redistribute it and or modify it", "free software you can", 4),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "in the hope that it will be useful", 4),
    ("gpl", "you should have received a copy of the gnu general public license", "received a copy of the gnu general", 4),
    ("gpl-2", "either version 2 of the license or at your option any later version", "either version 2 of the license", 4),
    ("gpl-3", "either version 3 of the license or at your option any later version", "either version 3 of the license", 4),
    ("gpl-2", "(?:gnu )?gpl(?: version)? ?v?2(?: 0)?(?: only| or later)?", "gpl", 2),
    ("gpl-3", "(?:gnu )?gpl(?: version)? ?v?3(?: 0)?(?: only| or later)?", "gpl", 2),
    ("gpl-2", "(?:gnu )?general public licen[sc]e(?: version)? ?v?2(?: 0)?", "general public licen", 2),
    ("gpl-3", "(?:gnu )?general public licen[sc]e(?: version)? ?v?3(?: 0)?", "general public licen", 2),
    ("gpl", "gnu general public licen[sc]e", "gnu general public licen", 2),
    ("gpl", "(?:gnu )?gpl licen[sc]e[sd]?", "gpl", 2),
    ("gpl", "licen[sc]e (?:is )?(?:the )?(?:gnu )?gpl", "gpl", 2),
    ("gpl", "gnu gpl", "gnu gpl", 1),
    ("gpl-classpath", "(?:with )?(?:the )?classpath exception", "classpath exception", 3),
    ("gpl-linking", "as a special exception .{1,60}? permission to link", "permission to link", 4),
    # LGPL, AGPL
    ("lgpl-2", "spdx license identifier lgpl 2 [01](?: only| or later)?", "identifier lgpl 2", 6),
    ("lgpl-3", "spdx license identifier lgpl 3 0(?: only| or later)?", "identifier lgpl 3", 6),
    ("lgpl", "under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl", "lgpl", 5),
    ("lgpl", "under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public licen", 5),
    ("lgpl-2", "(?:gnu )?lgpl(?: version)? ?v?2(?: [01])?(?: only| or later)?", "lgpl", 2),
    ("lgpl-3", "(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?(?: only| or later)?", "lgpl", 2),
    ("lgpl-2", "(?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? ?v?2(?: [01])?", "general public licen", 2),
    ("lgpl-3", "(?:gnu )?lesser general public licen[sc]e(?: version)? ?v?3(?: 0)?", "lesser general public licen", 2),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public licen", 2),
    ("lgpl", "(?:gnu )?lgpl(?: licen[sc]ed?)?", "lgpl", 2),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "library is free software you can", 4),
    ("agpl-3", "spdx license identifier agpl 3 0(?: only| or later)?", "identifier agpl", 6),
    ("agpl", "under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl", "agpl", 5),
    ("agpl", "under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[sc]e", "affero", 5),
    ("agpl-3", "(?:gnu )?agpl(?: version)? ?v?3(?: 0)?", "agpl", 2),
    ("agpl-3", "(?:gnu )?affero general public licen[sc]e(?: version)? ?v?3(?: 0)?", "affero", 2),
    ("agpl", "(?:gnu )?agpl(?: licen[sc]ed?)?", "agpl", 2),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "affero", 2),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", "free documentation licen", 2),
    ("gfdl", "permission is granted to copy distribute and or modify this document", "distribute and or modify this document", 4),
    # Mozilla, Eclipse, Sun, IBM, European
    ("mpl-1", "spdx license identifier mpl 1 [01]", "identifier mpl 1", 6),
    ("mpl-2", "spdx license identifier mpl 2 0", "identifier mpl 2", 6),
    ("mpl", "under (?:the )?(?:terms of (?:the )?)?mpl", "mpl", 5),
    ("mpl", "under (?:the )?(?:terms of (?:the )?)?mozilla public licen[sc]e", "mozilla public licen", 5),
    ("mpl-1", "mpl(?: version)? ?v?1(?: [01])?", "mpl", 2),
    ("mpl-2", "mpl(?: version)? ?v?2(?: 0)?", "mpl", 2),
    ("mpl-1", "mozilla public licen[sc]e(?: version)? ?v?1(?: [01])?", "mozilla public licen", 2),
    ("mpl-2", "mozilla public licen[sc]e(?: version)? ?v?2(?: 0)?", "mozilla public licen", 2),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", "source code form is subject", 4),
    ("mpl", "mozilla public licen[sc]e", "mozilla public licen", 2),
    ("mpl", "mpl licen[sc]e[sd]?", "mpl licen", 2),
    ("epl-1", "spdx license identifier epl 1 0", "identifier epl 1", 6),
    ("epl-2", "spdx license identifier epl 2 0", "identifier epl 2", 6),
    ("epl", "under (?:the )?(?:terms of (?:the )?)?(?:epl|eclipse public licen[sc]e)", "under ", 5),
    ("epl-1", "epl(?: version)? ?v?1(?: 0)?", " epl", 2),
    ("epl-2", "epl(?: version)? ?v?2(?: 0)?", " epl", 2),
    ("epl-1", "eclipse public licen[sc]e(?: version)? ?v?1(?: 0)?", "eclipse public licen", 2),
    ("epl-2", "eclipse public licen[sc]e(?: version)? ?v?2(?: 0)?", "eclipse public licen", 2),
    ("epl", "eclipse public licen[sc]e", "eclipse public licen", 2),
    ("cddl", "under (?:the )?(?:terms of (?:the )?)?cddl", "cddl", 5),
    ("cddl", "common development and distribution licen[sc]e", "common development and distribution", 2),
    ("cddl", "cddl(?: version)?(?: ?v?1(?: [01])?)?", "cddl", 1),
    ("cpl", "common public licen[sc]e(?: version)?(?: ?v?1(?: 0)?)?", "common public licen", 2),
    ("ipl", "ibm public licen[sc]e(?: version)?(?: ?v?1(?: 0)?)?", "ibm public licen", 2),
    ("eupl", "spdx license identifier eupl 1 [0-2]", "identifier eupl", 6),
    ("eupl", "european union public licen[sc]e", "european union public licen", 2),
    ("eupl", "eupl(?: version)?(?: ?v?1(?: [0-2])?)?", "eupl", 1),
    ("cecill", "cecill(?: (?:b|c|2 1|2 0))?", "cecill", 1),
    ("osl", "open software licen[sc]e(?: version)?(?: ?v?[123](?: [01])?)?", "open software licen", 2),
    ("afl", "academic free licen[sc]e(?: version)?(?: ?v?[123](?: [01])?)?", "academic free licen", 2),
    ("qpl", "q public licen[sc]e", "q public licen", 2),
    ("ms-pl", "under (?:the )?(?:terms of (?:the )?)?(?:ms pl|microsoft public licen[sc]e)", "under ", 5),
    ("ms-pl", "microsoft public licen[sc]e", "microsoft public licen", 2),
    ("ms-pl", "ms pl", "ms pl", 1),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "microsoft reciprocal", 2),
    # Short permissive licenses
    ("isc", "spdx license identifier isc", "identifier isc", 6),
    ("isc", "under (?:the )?(?:terms of (?:the )?)?isc(?: licen[sc]e)?", "isc", 5),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify", 4),
    ("isc", "(?:terms|conditions|text|copy) of the isc(?: licen[sc]e)?", " of the isc", 3),
    ("isc", "isc licen[sc]e[sd]?", "isc licen", 2),
    ("isc", "internet systems consortium licen[sc]e", "internet systems consortium", 2),
    ("zlib", "spdx license identifier zlib", "identifier zlib", 6),
    ("zlib", "under (?:the )?(?:terms of (?:the )?)?zlib(?: libpng)?(?: licen[sc]e)?", "zlib", 5),
    ("zlib", "this software is provided as is without any express or implied warranty", "provided as is without any express", 4),
    ("zlib", "(?:terms|conditions|text|copy) of the zlib(?: licen[sc]e)?", " of the zlib", 3),
    ("zlib", "zlib(?: libpng)? licen[sc]e[sd]?", "zlib", 2),
    ("libpng", "libpng licen[sc]e[sd]?", "libpng licen", 2),
    ("boost", "spdx license identifier bsl 1 0", "identifier bsl", 6),
    ("boost", "under (?:the )?(?:terms of (?:the )?)?boost software licen[sc]e", "boost software licen", 5),
    ("boost", "boost software licen[sc]e(?: version)?(?: 1 0)?", "boost software licen", 2),
    ("boost", "bsl 1 0", "bsl 1 0", 1),
    ("boost", "permission is hereby granted free of charge to any person or organization", "free of charge to any person or organization", 4),
    ("busl", "business source licen[sc]e(?: 1 1)?", "business source licen", 2),
    ("sspl", "server side public licen[sc]e", "server side public licen", 2),
    ("sspl", "sspl(?: 1 0| v1)?", "sspl", 1),
    ("elastic", "elastic licen[sc]e(?: 2 0| v2)?", "elastic licen", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", 4),
    ("unlicense", "(?:the )?unlicense", "unlicense", 1),
    ("wtfpl", "(?:under (?:the )?(?:terms of (?:the )?)?)?wtfpl", "wtfpl", 1),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "you want to public licen", 4),
    ("artistic-1", "artistic licen[sc]e(?: version)? ?v?1(?: 0)?", "artistic licen", 2),
    ("artistic-2", "artistic licen[sc]e(?: version)? ?v?2(?: 0)?", "artistic licen", 2),
    ("artistic", "under (?:the )?(?:terms of (?:the )?)?artistic(?: licen[sc]e)?", "artistic", 5),
    ("artistic", "(?:terms|conditions|text|copy) of the artistic(?: licen[sc]e)?", " of the artistic", 3),
    ("artistic", "artistic licen[sc]e", "artistic licen", 2),
    ("artistic", "under the same terms as perl itself", "same terms as perl", 4),
    ("python", "python software foundation licen[sc]e", "python software foundation licen", 2),
    ("python", "psf licen[sc]e", "psf licen", 2),
    ("python", "(?:terms|conditions|text|copy) of the psf(?: licen[sc]e)?", " of the psf", 3),
    ("python", "(?:terms|conditions|text|copy) of the python software foundation(?: licen[sc]e)?", " of the python", 3),
    ("python", "under (?:the )?(?:terms of (?:the )?)?(?:psf|python software foundation)(?: licen[sc]e)?", "under ", 5),
    ("postgresql", "under (?:the )?(?:terms of (?:the )?)?postgresql(?: licen[sc]e)?", "postgresql", 5),
    ("postgresql", "(?:terms|conditions|text|copy) of the postgresql(?: licen[sc]e)?", " of the postgresql", 3),
    ("postgresql", "postgresql licen[sc]e", "postgresql licen", 2),
    ("openssl", "under (?:the )?(?:terms of (?:the )?)?openssl(?: licen[sc]e)?", "openssl", 5),
    ("openssl", "(?:terms|conditions|text|copy) of the openssl(?: licen[sc]e)?", " of the openssl", 3),
    ("openssl", "openssl licen[sc]e", "openssl licen", 2),
    ("openssl", "this product includes software developed by the openssl project", "developed by the openssl", 4),
    ("php", "php licen[sc]e(?: version)?(?: 3 01?)?", "php licen", 2),
    ("ruby", "ruby licen[sc]e", "ruby licen", 2),
    ("vim", "vim licen[sc]e", "vim licen", 2),
    ("ncsa", "(?:university of illinois|ncsa) open source licen[sc]e", "open source licen", 2),
    ("w3c", "w3c (?:software|document)(?: notice and)? licen[sc]e", "w3c ", 2),
    ("unicode", "unicode licen[sc]e(?: agreement)?", "unicode licen", 2),
    ("upl", "universal permissive licen[sc]e", "universal permissive licen", 2),
    ("beerware", "beer ?ware(?: licen[sc]e)?", "beer", 1),
    ("json", "the software shall be used for good not evil", "used for good not evil", 4),
    # Fonts and data
    ("ofl", "spdx license identifier ofl 1 1", "identifier ofl", 6),
    ("ofl", "under (?:the )?(?:terms of (?:the )?)?(?:sil )?open font licen[sc]e", "open font licen", 5),
    ("ofl", "(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?", "open font licen", 2),
    ("ofl", "ofl 1 1", "ofl 1 1", 1),
    ("odbl", "under (?:the )?(?:terms of (?:the )?)?(?:odbl|open database licen[sc]e)", "under ", 5),
    ("odbl", "open database licen[sc]e", "open database licen", 2),
    ("odbl", "(?:terms|conditions|text|copy) of the odbl", " of the odbl", 3),
    ("odbl", "(?:terms|conditions|text|copy) of the open database licen[sc]e", " of the open", 3),
    ("odbl", "odbl(?: v?1 0)?", "odbl", 1),
    ("odc-by", "odc by", "odc by", 1),
    ("odc-by", "open data commons attribution licen[sc]e", "open data commons", 2),
    ("pddl", "pddl", "pddl", 1),
    ("pddl", "public domain dedication and licen[sc]e", "public domain dedication", 2),
    ("ogl", "open government licen[sc]e(?: v?[123](?: 0)?)?", "open government licen", 2),
    # Creative Commons
    ("cc0", "spdx license identifier cc0 1 0", "identifier cc0", 6),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0", 1),
    ("cc0", "(?:cc zero|creative commons zero)(?: v?1 0)?", "zero", 1),
    ("cc-by", "spdx license identifier cc by [1-4] [05]", "identifier cc by", 6),
    ("cc-by", "(?:licensed |released |available |published )?under (?:an? |the )?(?:terms of (?:the )?)?cc by(?! (?:sa|nc|nd))(?: [1-4] [05])?", "cc by", 5),
    ("cc-by", "cc by(?! (?:sa|nc|nd))(?: [1-4] [05])?", "cc by", 1),
    ("cc-by", "creative commons attribution(?! (?:share|sharealike|non|noncommercial|no|noderiv|noderivs|noderivatives))(?: [1-4] [05])?(?: (?:international|generic|unported))?", "creative commons attribution", 2),
    ("cc-by-sa", "(?:licensed |released |available |published )?under (?:an? |the )?(?:terms of (?:the )?)?cc by sa(?: [1-4] [05])?", "cc by sa", 5),
    ("cc-by-sa", "cc by sa(?: [1-4] [05])?", "cc by sa", 1),
    ("cc-by-sa", "creative commons attribution share ?alike(?: [1-4] [05])?", "creative commons attribution share", 2),
    ("cc-by-nc", "(?:licensed |released |available |published )?under (?:an? |the )?(?:terms of (?:the )?)?cc by nc(?! (?:sa|nd))(?: [1-4] [05])?", "cc by nc", 5),
    ("cc-by-nc", "cc by nc(?! (?:sa|nd))(?: [1-4] [05])?", "cc by nc", 1),
    ("cc-by-nc", "creative commons attribution non ?commercial(?! (?:share|sharealike|no|noderiv|noderivs|noderivatives))(?: [1-4] [05])?", "creative commons attribution non", 2),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa", 2),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "creative commons attribution non", 2),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd", 2),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?", "creative commons attribution non", 2),
    ("cc-by-nd", "cc by nd(?: [1-4] [05])?", "cc by nd", 2),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?", "creative commons attribution no", 2),
    ("cc", "this work is licensed under a creative commons", "under a creative commons", 4),
    ("cc", "some rights reserved", "some rights reserved", 3),
    # No license, or none that is open
    ("public-domain", "(?:released into|placed in|dedicated to|is in) the public domain", "the public domain", 4),
    ("public-domain", "public domain (?:work|software|code|dedication)", "public domain ", 3),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 3),
    ("all-rights-reserved", "all rights reserved worldwide", "all rights reserved worldwide", 4),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 4),
    ("proprietary", "confidential and proprietary", "confidential and proprietary", 4),
    ("proprietary", "unauthori[sz]ed (?:copying|use|distribution) (?:of this file )?.{0,40}?is (?:strictly )?prohibited", "unauthori", 4),
    ("proprietary", "(?:no part of this|this) (?:publication|document|book|work) may (?:not )?be reproduced", "be reproduced", 4),
    ("proprietary", "for internal use only", "for internal use only", 3),
    ("proprietary", "end user licen[sc]e agreement", "end user licen", 3),
    ("non-commercial", "for (?:personal|private) (?:and )?non ?commercial use only", "commercial use only", 4),
    ("non-commercial", "(?:not for|no) commercial use", " commercial use", 3),
    ("research-only", "for (?:academic |scientific )?research (?:purposes|use) only", "research ", 3),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright", 2),
    ("copyright", "c copyright (?:by )?(?:19|20)[0-9]{2}", "c copyright", 2),
    ("creative-commons", "creative commons licen[sc]e[sd]?", "creative commons licen", 2),
    ("osi", "osi approved(?: open source)? licen[sc]e", "osi approved", 2),
]
