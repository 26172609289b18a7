"""License scans by ordered signature rules. DataFrame functions only."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: A word of a text whose A-Z are lower-cased, and of one whose letters are as they were.
WORD, RAW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Confidence of a detection, by the priority of its rule: refusals, tags and addresses, notices and bodies, grants, names.
CONFIDENCE = (0.0, 0.99, 0.95, 0.9, 0.7, 0.5)

#: Signatures by keyword, in the order of trust that the digit gives: priority, label (- for what is no license), then the
#: regex over lower-case words with one space between, punctuation left out. A text that a rule fits contains its keyword.
SIGNATURES = {
    " not licensed": r"""
0 - not licensed under (?:the )?(?:terms of )?(?:the )?(?:[a-z0-9]+ ){1,8}licen[sc]e
0 - not licensed under (?:the )?(?:gnu )?(?:gpl|lgpl|agpl|mit|bsd|apache|mpl|isc|cc by)
0 - not licensed for (?:commercial use|redistribution)
""",
    " not released": r"""
0 - not released under (?:the )?(?:terms of )?(?:the )?(?:[a-z0-9]+ ){1,8}licen[sc]e
0 - not released under (?:the )?(?:gnu )?(?:gpl|lgpl|agpl|mit|bsd|apache|mpl|isc|cc by)
""",
    " compatible with": r"""
0 - (?:not )?compatible with (?:the )?(?:[a-z0-9]+ ){0,6}licen[sc]es?
0 - (?:not )?compatible with (?:the )?(?:gnu )?(?:gpl|lgpl|agpl|mit|bsd|apache|mpl)(?: ?v?[0-9]+(?: [0-9]+)?)?
""",
    " incompatible with": r"""
0 - incompatible with (?:the )?(?:[a-z0-9]+ ){0,6}licen[sc]es?
0 - incompatible with (?:the )?(?:gnu )?(?:gpl|lgpl|agpl|mit|bsd|apache|mpl)(?: ?v?[0-9]+(?: [0-9]+)?)?
""",
    " spdx license": r"""
1 agpl spdx license identifier agpl [0-9](?: [0-9])?(?: only| or later)?
1 lgpl spdx license identifier lgpl [0-9](?: [0-9])?(?: only| or later)?
1 gpl spdx license identifier gpl [0-9](?: [0-9])?(?: only| or later)?(?: with classpath exception 2 0)?
1 gfdl spdx license identifier gfdl 1 [0-9](?: only| or later)?
1 apache spdx license identifier apache [12] [0-9]
1 mit spdx license identifier mit(?: 0| cmu| modern variant)?
1 bsd spdx license identifier 0bsd
1 bsd-2-clause spdx license identifier bsd 2 clause(?: patent| views)?
1 bsd-3-clause spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?
1 bsd-4-clause spdx license identifier bsd 4 clause(?: uc)?
1 isc spdx license identifier isc
1 mpl spdx license identifier mpl [12] [0-9]
1 epl spdx license identifier epl [12] 0
1 cddl spdx license identifier cddl 1 [01]
1 eupl spdx license identifier eupl 1 [0-2]
1 artistic spdx license identifier artistic [12] 0
1 boost spdx license identifier bsl 1 0
1 zlib spdx license identifier zlib
1 unlicense spdx license identifier unlicense
1 wtfpl spdx license identifier wtfpl
1 python spdx license identifier (?:psf|python) 2 0
1 postgresql spdx license identifier postgresql
1 openssl spdx license identifier openssl
1 ms-pl spdx license identifier ms pl
1 ms-rl spdx license identifier ms rl
1 ofl spdx license identifier ofl 1 [01]
1 cecill spdx license identifier cecill (?:1 0|2 0|2 1|b|c)
1 odbl spdx license identifier odbl 1 0
1 ncsa spdx license identifier ncsa
1 php spdx license identifier php 3 0[01]?
1 ruby spdx license identifier ruby
1 upl spdx license identifier upl 1 0
1 osl spdx license identifier osl [123] [01]
1 afl spdx license identifier afl [123] [0-2]
1 sspl spdx license identifier sspl 1 0
1 busl spdx license identifier busl 1 1
1 elastic spdx license identifier elastic 2 0
1 cc0 spdx license identifier cc0 1 0
1 cc-by spdx license identifier cc by [1-4] [05]
1 cc-by-sa spdx license identifier cc by sa [1-4] [05]
1 cc-by-nc spdx license identifier cc by nc [1-4] [05]
1 cc-by-nd spdx license identifier cc by nd [1-4] [05]
1 cc-by-nc-sa spdx license identifier cc by nc sa [1-4] [05]
1 cc-by-nc-nd spdx license identifier cc by nc nd [1-4] [05]
""",
    " opensource org": r"""
1 mit opensource org licen[sc]es? mit(?: license)?
1 apache opensource org licen[sc]es? apache 2 0
1 bsd-2-clause opensource org licen[sc]es? bsd 2 clause
1 bsd-3-clause opensource org licen[sc]es? bsd 3 clause
1 bsd opensource org licen[sc]es? bsd license
1 isc opensource org licen[sc]es? isc
1 gpl opensource org licen[sc]es? gpl (?:[23] 0|license)
1 lgpl opensource org licen[sc]es? lgpl (?:2 1|3 0|license)
1 mpl opensource org licen[sc]es? mpl [12] [01]
1 artistic opensource org licen[sc]es? artistic license(?: 2 0)?
1 zlib opensource org licen[sc]es? zlib
""",
    " gnu org": r"""
1 agpl gnu org licen[sc]es agpl(?: 3 0)?(?: html| txt)?
1 lgpl gnu org licen[sc]es (?:old licenses )?lgpl(?: [23] [01])?(?: html| txt)?
1 gpl gnu org licen[sc]es (?:old licenses )?gpl(?: [123] 0)?(?: html| txt)?
1 gfdl gnu org licen[sc]es fdl(?: 1 [123])?(?: html| txt)?
4 gpl gnu org copyleft gpl(?: html)?
""",
    " gnu": r"""
2 gpl you should have received a copy of the gnu general public licen[sc]e
2 lgpl you should have received a copy of the gnu lesser general public licen[sc]e
2 agpl you should have received a copy of the gnu affero general public licen[sc]e
2 gpl under the terms of the gnu general public licen[sc]e as published by the free software foundation
2 lgpl under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation
2 agpl under the terms of the gnu affero general public licen[sc]e as published by the free software foundation
2 gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
3 gpl under (?:the )?(?:terms of )?(?:the )?gnu (?:general public licen[sc]e|gpl)(?: version| v)? ?[123](?: 0)?(?: only| or (?:any )?later(?: version)?)?
3 lgpl under (?:the )?(?:terms of )?(?:the )?gnu (?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?[23](?: [01])?(?: only| or (?:any )?later(?: version)?)?
3 agpl under (?:the )?(?:terms of )?(?:the )?gnu (?:affero general public licen[sc]e|agpl)(?: version| v)? ?[13](?: 0)?(?: only| or (?:any )?later(?: version)?)?
4 gpl gnu general public licen[sc]e(?: version| v)?(?: [123](?: 0)?)?(?: only| or (?:any )?later(?: version)?)?
4 gpl gnu public licen[sc]e(?: version| v)?(?: [123](?: 0)?)?
4 lgpl gnu lesser general public licen[sc]e(?: version| v)?(?: [23](?: [01])?)?(?: or (?:any )?later(?: version)?)?
4 lgpl gnu library (?:or lesser )?general public licen[sc]e(?: version| v)?(?: [23](?: [01])?)?
4 agpl gnu affero general public licen[sc]e(?: version| v)?(?: [13](?: 0)?)?(?: or (?:any )?later(?: version)?)?
4 gfdl gnu free documentation licen[sc]e(?: version| v)?(?: 1 [123])?
5 gpl gnu gpl
""",
    " affero": r"""
4 agpl affero general public licen[sc]e(?: version| v)?(?: [13](?: 0)?)?
""",
    " gpl": r"""
2 gpl dual (?:mit|bsd) (?:and )?gpl
3 gpl (?:under|is) (?:the )?(?:terms of )?(?:the )?gpl
4 gpl gpl (?:version |v ?)?[123](?: 0)?(?: only| or (?:any )?later(?: versions?)?)?
4 gpl gpl licen[sc]ed?
5 gpl gplv[123](?: only| or (?:any )?later(?: versions?)?)?
3 gpl (?:under|is) (?:the )?(?:terms of )?(?:the )?gplv[123](?: only| or (?:any )?later(?: versions?)?)?
5 gpl gpl[123](?: only| or later)?
""",
    " lgpl": r"""
3 lgpl (?:under|is) (?:the )?(?:terms of )?(?:the )?lgpl(?:v[23])?(?: [01])?
4 lgpl lgpl (?:version |v ?)?[23](?: [01])?(?: only| or (?:any )?later(?: versions?)?)?
4 lgpl lgpl licen[sc]ed?
5 lgpl lgplv?[23](?: [01])?(?: only| or (?:any )?later(?: versions?)?)?
""",
    " agpl": r"""
3 agpl (?:under|is) (?:the )?(?:terms of )?(?:the )?agpl(?:v[13])?
4 agpl agpl (?:version |v ?)?[13](?: 0)?(?: only| or (?:any )?later(?: versions?)?)?
4 agpl agpl licen[sc]ed?
5 agpl agplv?[13](?: 0)?(?: only| or (?:any )?later(?: versions?)?)?
""",
    " gfdl": r"""
3 gfdl under (?:the )?(?:terms of )?(?:the )?gfdl(?: 1 [123])?
5 gfdl gfdl(?: v?1 [123])?
""",
    " free software foundation": r"""
5 gpl free software foundation either version [123] (?:of the licen[sc]e )?or at your option any later version
""",
    " apache": r"""
1 apache apache org licen[sc]es(?: license 2 0)?(?: html| txt)?
2 apache licensed under the apache licen[sc]e version 2 0 the license you may not use this file except in compliance with the license
2 apache licensed to the apache software foundation asf under one or more contributor license agreements
3 apache under (?:the )?(?:terms of )?(?:the )?apache(?: software| public)? licen[sc]e(?: version| v)? ?[12](?: [01])?
3 apache under (?:the )?(?:terms of )?(?:the )?apache(?: licen[sc]e)?(?: version| v)? ?[12](?: [01])?
3 apache under (?:the )?(?:terms of )?(?:the )?apache(?: software| public)? licen[sc]e
4 apache apache(?: software| public)? licen[sc]e(?: version| v)?(?: [12](?: [01])?)?
5 apache apache (?:version |v ?)?[12] [01](?: licen[sc]ed?)?
""",
    " asl ": r"""
4 apache asl (?:version |v ?)?2(?: 0)?
""",
    " you may not use this file": r"""
3 apache you may not use this file except in compliance with the license
""",
    " mit licen": r"""
3 mit under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
4 mit mit licen[sc]ed?
""",
    " mit x11": r"""
3 mit under (?:the )?(?:terms of )?(?:the )?mit x11 licen[sc]e
4 mit mit x11 licen[sc]ed?
""",
    " mit expat": r"""
4 mit mit expat licen[sc]ed?
""",
    " mit style": r"""
4 mit mit style licen[sc]ed?
""",
    " under mit": r"""
3 mit (?:licensed|released|distributed|available|published|provided) under mit
""",
    " under the mit": r"""
3 mit (?:licensed|released|distributed|available|published|provided) under the mit
""",
    " terms of the mit": r"""
3 mit under (?:the )?terms of the mit
""",
    " license mit": r"""
5 mit license mit
""",
    " expat": r"""
4 mit expat(?: mit)? licen[sc]e
""",
    " x11": r"""
3 x11 under (?:the )?(?:terms of )?(?:the )?x11 licen[sc]e
4 x11 x11 licen[sc]e
""",
    " permission is hereby granted": r"""
2 mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2 boost permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
2 ofl permission is hereby granted free of charge to any person obtaining a copy of the font software
2 postgresql permission is hereby granted without written agreement and without license or royalty fees
5 mit permission is hereby granted free of charge to any person
""",
    " the above copyright notice and this permission notice": r"""
2 mit the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 isc the above copyright notice and this permission notice appear in all copies
""",
    " permission to use copy modify": r"""
2 isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
2 postgresql permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
4 isc permission to use copy modify and (?:or )?distribute this software
""",
    " redistribution and use in source": r"""
2 bsd redistribution and use in source and binary forms with or without modification are permitted
""",
    " redistributions": r"""
4 bsd redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
4 bsd redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
""",
    " neither the name of": r"""
2 bsd-3-clause neither the name of (?:[a-z0-9]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products
""",
    " all advertising materials": r"""
2 bsd-4-clause all advertising materials mentioning features or use of this software must display the following acknowledge?ment
""",
    " bsd": r"""
3 bsd-2-clause under (?:the )?(?:terms of )?(?:the )?(?:simplified bsd|bsd 2 clause)(?: licen[sc]e)?
3 bsd-3-clause under (?:the )?(?:terms of )?(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause)(?: licen[sc]e)?
3 bsd-4-clause under (?:the )?(?:terms of )?(?:the )?(?:original bsd|bsd 4 clause)(?: licen[sc]e)?
3 bsd under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style| like)?(?: licen[sc]e)?
4 bsd-2-clause (?:simplified|two clause|2 clause) bsd licen[sc]e
4 bsd-3-clause (?:new|modified|revised|three clause|3 clause) bsd licen[sc]e
4 bsd-4-clause (?:original|four clause|4 clause) bsd licen[sc]e
4 bsd-2-clause bsd 2 clause(?: licen[sc]e)?
4 bsd-3-clause bsd 3 clause(?: licen[sc]e)?
4 bsd-4-clause bsd 4 clause(?: licen[sc]e)?
5 bsd bsd(?: style| like)? licen[sc]ed?
""",
    " freebsd": r"""
4 bsd-2-clause freebsd licen[sc]e
""",
    " berkeley software distribution": r"""
4 bsd berkeley software distribution licen[sc]e
""",
    " isc ": r"""
3 isc under (?:the )?(?:terms of )?(?:the )?isc licen[sc]e
4 isc isc licen[sc]ed?
""",
    " internet systems consortium": r"""
4 isc internet systems consortium licen[sc]e
""",
    " mozilla org": r"""
1 mpl mozilla org mpl(?: [12] [01])?
""",
    " mozilla public": r"""
2 mpl this source code form is subject to the terms of the mozilla public licen[sc]e(?: version| v) [12] [01]
2 mpl the contents of this file are subject to the mozilla public licen[sc]e(?: version| v) [12] [01]
3 mpl under (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e(?: version| v)?(?: [12] [01])?
4 mpl mozilla public licen[sc]e(?: version| v)?(?: [12](?: [01])?)?
""",
    " mpl": r"""
3 mpl under (?:the )?(?:terms of )?(?:the )?mpl(?: v)?(?: [12] [01])?
4 mpl mpl (?:version |v ?)?[12](?: [01])?
5 mpl mplv?[12](?: [01])?
""",
    " eclipse org": r"""
1 epl eclipse org legal epl (?:v10|2 0|v20)
""",
    " eclipse public": r"""
2 epl made available under the terms of the eclipse public licen[sc]e(?: version| v)?(?: ?[12] 0)?
3 epl under (?:the )?(?:terms of )?(?:the )?eclipse public licen[sc]e(?: version| v)?(?: [12] 0)?
4 epl eclipse public licen[sc]e(?: version| v)?(?: [12](?: 0)?)?
""",
    " epl": r"""
4 epl epl (?:version |v ?)?[12](?: 0)?
5 epl eplv?[12]0?
""",
    " common development": r"""
3 cddl under (?:the )?(?:terms of )?(?:the )?common development and distribution licen[sc]e
4 cddl common development and distribution licen[sc]e(?: version| v)?(?: 1 [01])?
""",
    " cddl": r"""
4 cddl cddl (?:version |v ?)?1(?: [01])?
""",
    " common public": r"""
4 cpl common public licen[sc]e(?: version| v)?(?: 1 0)?
4 cpal common public attribution licen[sc]e(?: version| v)?(?: 1 0)?
""",
    " european union public": r"""
3 eupl under (?:the )?(?:terms of )?(?:the )?european union public licen[sc]e
4 eupl european union public licen[sc]e(?: version| v)?(?: ?1 [012])?
""",
    " eupl": r"""
4 eupl eupl (?:version |v ?)?1 [012]
""",
    " artistic licen": r"""
2 artistic the same terms as perl itself under the artistic licen[sc]e
4 artistic artistic licen[sc]e(?: version| v)?(?: [12](?: 0)?)?
""",
    " terms as perl": r"""
3 artistic under the same terms as perl(?: 5)?(?: itself)?
""",
    " boost org": r"""
1 boost boost org license 1 0 txt
""",
    " boost software": r"""
2 boost distributed under the boost software licen[sc]e version 1 0
4 boost boost software licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
""",
    " zlib": r"""
4 zlib zlib(?: libpng)? licen[sc]e
""",
    " in no event will the authors": r"""
2 zlib in no event will the authors be held liable for any damages arising from the use of this software
""",
    " altered source versions": r"""
2 zlib altered source versions must be plainly marked as such and must not be misrepresented as being the original software
""",
    " this is free and unencumbered": r"""
2 unlicense this is free and unencumbered software released into the public domain
""",
    " unlicense": r"""
1 unlicense unlicense org
3 unlicense under the unlicense
4 unlicense unlicense licen[sc]e
""",
    " the unlicense": r"""
4 unlicense the unlicense
""",
    " do what the fuck": r"""
4 wtfpl do what the fuck you want to public licen[sc]e(?: version| v)?(?: 2)?
""",
    " you just do what the fuck": r"""
2 wtfpl you just do what the fuck you want to
""",
    " wtfpl": r"""
3 wtfpl under (?:the )?(?:terms of )?(?:the )?wtfpl
5 wtfpl wtfpl(?: licen[sc]e)?
""",
    " python software foundation": r"""
4 python python software foundation licen[sc]e(?: version| v)?(?: 2(?: 0)?)?
""",
    " python license": r"""
5 python python license
""",
    " postgresql": r"""
3 postgresql under (?:the )?(?:terms of )?(?:the )?postgresql licen[sc]e
4 postgresql postgresql licen[sc]e
""",
    " openssl": r"""
4 openssl openssl(?: ssleay)? licen[sc]e
""",
    " this product includes software developed by the openssl": r"""
2 openssl this product includes software developed by the openssl project
""",
    " microsoft public": r"""
4 ms-pl microsoft public licen[sc]e
""",
    " microsoft reciprocal": r"""
4 ms-rl microsoft reciprocal licen[sc]e
""",
    " open font": r"""
3 ofl under (?:the )?(?:terms of )?(?:the )?sil open font licen[sc]e(?: version| v)?(?: 1 [01])?
4 ofl (?:sil )?open font licen[sc]e(?: version| v)?(?: 1 [01])?
""",
    " ofl": r"""
3 ofl under (?:the )?(?:terms of )?(?:the )?(?:sil )?ofl
""",
    " cecill": r"""
4 cecill cecill(?: [bc])?(?: free software)? licen[sc]e(?: agreement)?
""",
    " open database": r"""
3 odbl under (?:the )?(?:terms of )?(?:the )?(?:open data commons )?open database licen[sc]e
4 odbl (?:open data commons )?open database licen[sc]e(?: version| v)?(?: 1 0)?
""",
    " odbl": r"""
3 odbl under (?:the )?(?:terms of )?(?:the )?odbl
5 odbl odbl(?: 1 0| licen[sc]ed?)
""",
    " open data commons": r"""
4 odc-by open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?
4 pddl open data commons public domain dedication and licen[sc]e
""",
    " ncsa": r"""
4 ncsa (?:university of illinois )?ncsa open source licen[sc]e
""",
    " php license": r"""
4 php php license(?: version| v)?(?: 3 0[01]?)?
""",
    " terms as ruby": r"""
3 ruby under the same terms as ruby(?: itself)?
""",
    " ruby licen": r"""
5 ruby ruby licen[sc]e
""",
    " vim license": r"""
5 vim vim license
""",
    " w3c": r"""
4 w3c w3c software(?: and document)? notice and licen[sc]e
4 w3c w3c licen[sc]e
""",
    " universal permissive": r"""
4 upl universal permissive licen[sc]e(?: version| v)?(?: 1 0)?
""",
    " open software license": r"""
4 osl open software license(?: version| v)?(?: [123] [01])?
""",
    " academic free": r"""
4 afl academic free licen[sc]e(?: version| v)?(?: [123] [012])?
""",
    " server side public": r"""
4 sspl server side public licen[sc]e(?: version| v)?(?: 1)?
""",
    " business source": r"""
4 busl business source licen[sc]e(?: version| v)?(?: 1 1)?
""",
    " elastic license": r"""
4 elastic elastic license(?: version| v)?(?: 2(?: 0)?)?
""",
    " creativecommons org": r"""
1 cc-by creativecommons org licenses by [1-4] [05]
1 cc-by-sa creativecommons org licenses by sa [1-4] [05]
1 cc-by-nc creativecommons org licenses by nc [1-4] [05]
1 cc-by-nd creativecommons org licenses by nd [1-4] [05]
1 cc-by-nc-sa creativecommons org licenses by nc sa [1-4] [05]
1 cc-by-nc-nd creativecommons org licenses by nc nd [1-4] [05]
1 cc0 creativecommons org publicdomain zero 1 0
1 public-domain creativecommons org publicdomain mark 1 0
""",
    " creative commons": r"""
4 cc0 creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
4 cc-by creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
4 cc-by-sa creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
4 cc-by-nc creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
4 cc-by-nd creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
4 cc-by-nc-sa creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
4 cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
5 cc-by creative commons by(?: [1-4] [05])?
5 cc-by-sa creative commons by sa(?: [1-4] [05])?
""",
    " cc by": r"""
3 cc-by under (?:a |the )?(?:terms of )?(?:the )?cc by(?: [1-4] [05])?(?: licen[sc]e)?
3 cc-by-sa under (?:a |the )?(?:terms of )?(?:the )?cc by sa(?: [1-4] [05])?(?: licen[sc]e)?
3 cc-by-nc under (?:a |the )?(?:terms of )?(?:the )?cc by nc(?: [1-4] [05])?(?: licen[sc]e)?
3 cc-by-nd under (?:a |the )?(?:terms of )?(?:the )?cc by nd(?: [1-4] [05])?(?: licen[sc]e)?
3 cc-by-nc-sa under (?:a |the )?(?:terms of )?(?:the )?cc by nc sa(?: [1-4] [05])?(?: licen[sc]e)?
3 cc-by-nc-nd under (?:a |the )?(?:terms of )?(?:the )?cc by nc nd(?: [1-4] [05])?(?: licen[sc]e)?
4 cc-by cc by(?: [1-4] [05])?
4 cc-by-sa cc by sa(?: [1-4] [05])?
4 cc-by-nc cc by nc(?: [1-4] [05])?
4 cc-by-nd cc by nd(?: [1-4] [05])?
4 cc-by-nc-sa cc by nc sa(?: [1-4] [05])?
4 cc-by-nc-nd cc by nc nd(?: [1-4] [05])?
""",
    " cc0": r"""
3 cc0 under (?:the )?(?:terms of )?(?:the )?cc0
5 cc0 cc0(?: 1 0)?(?: universal)?
""",
    " public domain": r"""
0 - not in the public domain
3 public-domain (?:released|placed|dedicated) (?:in|into|to) the public domain
5 public-domain public domain
""",
    " all rights reserved": r"""
4 proprietary all rights reserved
""",
    " proprietary and confidential": r"""
4 proprietary proprietary and confidential
""",
    " no part of this": r"""
2 proprietary no part of this (?:publication|book|document|work) may be reproduced
""",
    " no license is granted": r"""
2 proprietary no license is granted
""",
    " end user license": r"""
4 proprietary end user license agreement
""",
}


@cache
def rules() -> tuple[tuple[str, int, str, str], ...]:
    """(keyword, priority, label, regex) of all signatures; a regex begins with the space before its first word."""
    out = []
    for keyword, block in SIGNATURES.items():
        for line in block.strip().splitlines():
            priority, label, regex = line.split(" ", 2)
            out.append((keyword, int(priority), label, f" {regex}(?= )"))
    return tuple(out)


@cache
def gate() -> str:
    """What a text that any keyword stands in must fit, whatever stands between its words. First letters come as classes,
    as they are compared at each word, and letters in any case cost more."""
    by_letter: dict[str, set[str]] = {}
    for k in SIGNATURES:
        form = "[^a-z0-9]+".join(k[1:].split()) + ("[^a-z0-9]" if k.endswith(" ") else "")
        by_letter.setdefault(form[0], set()).add(form[1:])
    return "(?<![a-zA-Z0-9])(?:" + "|".join(f"[{c}{c.upper()}](?i:{'|'.join(sorted(rest))})" for c, rest in sorted(by_letter.items())) + ")"


_FOUND = "array<struct<start:int,back:int,priority:int,rule:int,label:string>>"


def _table() -> Column:
    """The signatures as one literal: array<struct<keyword, rules: array<struct<rule, priority, label, regex>>>>. A regex has
    what precedes the match, from the end of the last one (\\G: without it a text is searched anew from each place)."""
    by_keyword: dict[str, list[str]] = {}
    for n, (keyword, priority, label, regex) in enumerate(rules()):
        by_keyword.setdefault(keyword, []).append(f"named_struct('rule', {n}, 'priority', {priority}, 'label', '{label}', 'regex', r'(?s)\\G(.*?)({regex})')")
    return F.expr("array(" + ", ".join(f"named_struct('keyword', '{k}', 'rules', array({', '.join(x)}))" for k, x in by_keyword.items()) + ")")


def _spans(norm: Column, rule: Column) -> Column:
    """struct(start, back, priority, rule, label) of each match, from the pieces before the matches and the matches. back
    is the end with its sign changed, so that of detections with one start the longest sorts first."""
    gaps, found = F.regexp_extract_all(norm, rule["regex"], F.lit(1)), F.regexp_extract_all(norm, rule["regex"], F.lit(2))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        end = at + F.length(pair["match"])
        span = F.struct(at.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), start, step, lambda acc: acc["out"])


def detections(norm: Column) -> Column:
    """All matches of all rules, by start, then length, priority and order of the rules. The rules of a keyword are tried
    where it stands."""
    tried = F.flatten(F.transform(F.filter(_table(), lambda k: F.contains(norm, k["keyword"])), lambda k: k["rules"]))
    return F.array_sort(F.flatten(F.transform(tried, lambda r: _spans(norm, r))))


def resolved(found: Column) -> Column:
    """struct(labels, best): what detections, sorted as above, leave when overlaps are resolved.

    A detection goes if it lies within one of equal or better priority (of equal intervals, the first in order stays), or
    if one of better priority shares a word with it. One pass from left to right: `reach` has the furthest end so far by
    priority or better, and detections that a later one may still meet wait.
    """
    waiting = "array<struct<end:int,priority:int,label:string>>"
    levels = len(CONFIDENCE)
    start = F.struct(F.array(*[F.lit(0)] * levels).alias("reach"), F.array().cast(waiting).alias("wait"), F.array().cast("array<string>").alias("labels"), F.lit(levels).alias("best"))

    def close(acc: Column, done: Column) -> tuple[Column, Column]:
        real = F.filter(done, lambda w: w["label"] != "-")
        labels = F.array_union(acc["labels"], F.transform(real, lambda w: w["label"]))
        return labels, F.least(acc["best"], F.array_min(F.transform(real, lambda w: w["priority"])))

    def take(acc: Column, x: Column) -> Column:
        end, at = -x["back"], x["priority"]
        inside = F.get(acc["reach"], at) >= end
        crossed = F.coalesce(F.get(acc["reach"], at - 1) > x["start"], F.lit(False))
        labels, best = close(acc, F.filter(acc["wait"], lambda w: w["end"] <= x["start"]))
        wait = F.filter(acc["wait"], lambda w: (w["end"] > x["start"]) & (w["priority"] <= at))
        own = F.array(F.struct(end.alias("end"), at.alias("priority"), x["label"].alias("label")))
        reach = F.transform(acc["reach"], lambda r, i: F.when(i >= at, F.greatest(r, end)).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(inside | crossed, wait).otherwise(F.concat(wait, own)).alias("wait"), labels.alias("labels"), best.alias("best"))

    def finish(acc: Column) -> Column:
        labels, best = close(acc, acc["wait"])
        return F.struct(labels.alias("labels"), best.alias("best"))

    return F.aggregate(found, start, take, finish)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs.

    Texts that pass a keyword test are lower-cased and written as words with one space between; the rules whose keyword
    they contain are then searched, and overlapping detections resolved. Refusals ("not licensed under ...") suppress
    what they contain and give no label. Base phrases are counted wherever they stand, and their labels stay. score is the
    confidence of the most trusted detection that is left, 0 without.

    Null or empty text: no words, no labels (empty strings), score 0. Very long texts are scanned whole, in time that
    grows with the square of the matches of one rule (copies of small arrays). Ties: of two rules that fit one interval,
    the first listed gives the label. Null doc_id and repeated rows pass through; other columns are ignored; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"), text.alias("text"), text.rlike(gate()).alias("gated"))
    words = F.when(F.col("gated"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({WORD})"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    d = d.select("doc_id", "n_words", "gated", words.alias("words"))
    d = d.select("doc_id", "n_words", "words", F.when(F.col("gated"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise(F.lit("")).alias("norm"))

    def stands(i: Column, phrase: str) -> Column:
        out = F.lit(True)
        for k, w in enumerate(phrase.split()):
            out = out & F.coalesce(F.get("words", i + k) == w, F.lit(False))
        return out

    def any_phrase(i: Column) -> Column:
        out = F.lit(False)
        for p, _ in PHRASES:
            out = out | stands(i, p)
        return out

    places = F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), any_phrase)).otherwise(F.array().cast("array<int>"))
    kept = F.when(F.col("norm") != "", resolved(detections(F.col("norm"))))
    d = d.select("doc_id", "n_words", "words", places.alias("places"), kept.alias("kept"))
    label_of = F.create_map(*[F.lit(x) for p, label in PHRASES for x in (p.split()[0], label)])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda i: F.element_at(label_of, F.get("words", i)))))
    d = d.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.get("places", F.lit(0)).cast("long").alias("first_word"), F.get("places", F.size("places") - 1).cast("long").alias("last_word"), base.alias("base"), "kept")
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("kept.labels", F.array().cast("array<string>")))), ",")
    score = F.coalesce(F.get(F.array(*map(F.lit, CONFIDENCE)), F.col("kept.best")), F.lit(0.0))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
