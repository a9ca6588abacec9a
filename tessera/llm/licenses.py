"""License scans: ordered signature rules over normalised words.

Hundreds of expressions, written by hand: sentences of the licenses themselves, notices, tags and package metadata, names. Words are lower case, joined by one space, so layout
and punctuation have no bearing. Each rule is gated by a keyword, a word that any of its matches holds: a text without any keyword is left at once, and a rule looks only at the words around
its keywords. Detections have a word interval, a priority and a confidence. One that lies inside the interval of another with a better priority (or of
the same priority and longer) is suppressed.

Defined results: null and empty texts have no words, no labels and score 0; a very long text full of notices takes time in proportion; repeated rows each get a result; columns other than doc_id and
text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ship, texts
from tessera.llm.words import PLAIN, rows

#: Phrases whose places the base of the contract counts, with their labels.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
#: One signature a line: label, priority (0 is the strongest), confidence, keyword (a word that every match holds; several: one of them) and the expression over words in
#: lower case joined by one space. Texts of licenses come first, then notices, tags and metadata, full names, short names.
SIGNATURES = """
mit | 0 | 1.0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 0 | 0.95 | sublicense | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
isc | 0 | 1.0 | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 0 | 1.0 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 0 | 0.95 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 0 | 0.95 | endorse | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
apache | 0 | 1.0 | compliance | you may not use this file except in compliance with the license
apache | 0 | 0.98 | apache | apache license version 2 0 january 2004
gpl | 0 | 1.0 | redistribute | this program is free software you can redistribute it and or modify it
gpl | 0 | 0.95 | gnu | you should have received a copy of the gnu general public license
lgpl | 0 | 1.0 | redistribute | this library is free software you can redistribute it and or modify it
lgpl | 0 | 0.95 | lesser | you should have received a copy of the gnu lesser general public license
agpl | 0 | 0.95 | affero | you should have received a copy of the gnu affero general public license
gpl | 0 | 0.9 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
boost | 0 | 1.0 | hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | 0 | 1.0 | implied | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 0 | 0.95 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | 0 | 1.0 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 0 | 1.0 | fuck | you just do what the fuck you want to
proprietary | 0 | 1.0 | unauthorized | all rights reserved unauthorized copying of this file via any medium is strictly prohibited
proprietary | 0 | 0.9 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 1 | 0.9 | reproduced | no part of this (?:work|publication|book|document) may be reproduced
cc0 | 0 | 0.98 | waived | to the extent possible under law .{1,120}? (?:has|have) waived all copyright
mpl | 0 | 1.0 | mozilla | this source code form is subject to the terms of the mozilla public license
mpl | 0 | 0.95 | mpl | if a copy of the mpl was not distributed with this file
epl | 0 | 1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | 0 | 1.0 | cddl | the contents of this file are subject to the terms of .{0,60}?cddl
eupl | 0 | 1.0 | eupl | licensed under the eupl
ofl | 0 | 1.0 | font | this font software is licensed under the sil open font license
artistic | 0 | 0.95 | artistic | the intent of this document is to state the conditions under which a package may be copied
python | 0 | 0.95 | psf | psf is making python available to licensee on an as is basis
openssl | 0 | 1.0 | openssl | this product includes software developed by the openssl project
x11 | 0 | 0.95 | consortium | except as contained in this notice the name of the x consortium shall not be used
beerware | 0 | 1.0 | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
json | 0 | 1.0 | evil | the software shall be used for good not evil
curl | 0 | 0.95 | curl | copyright .{1,60}? daniel stenberg .{1,200}? curl
ncsa | 0 | 0.95 | ncsa | university of illinois ncsa open source license
postgresql | 0 | 0.95 | postgresql | postgresql is released under the postgresql license
vim | 0 | 0.95 | vim | vim is charityware
odbl | 0 | 0.95 | database | this .{1,60}? is made available under the open database license
mit | 1 | 0.98 | mit | (?:licensed|licenced|released|distributed|available|provided|published|offered|shared) under (?:the )?(?:terms of )?(?:the )?(?:an )?mit(?: open source)?(?: licen[cs]e)?
mit | 1 | 0.95 | expat | (?:licensed|released|distributed|available) under (?:the )?expat(?: licen[cs]e)?
mit | 1 | 0.95 | mit | (?:subject to|governed by|covered by|according to) (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
apache | 1 | 0.98 | apache | (?:licensed|licenced|released|distributed|available|provided|published|offered|shared) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: public)?(?: licen[cs]e)?(?: version| v)?(?: 2 0| 2| 1 1| 1 0)?
apache | 1 | 0.95 | apache | (?:subject to|governed by|covered by|according to) (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version| v)?(?: 2 0| 2| 1 1| 1 0)?
apache | 1 | 0.95 | asl | (?:licensed|released|distributed) under (?:the )?asl(?: 2 0| 2)?
gpl | 1 | 0.98 | general | (?:licensed|licenced|released|distributed|available|provided|published|offered|shared) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e(?: version| v)?(?: [123](?: 0)?)?(?: or (?:any )?(?:later|newer)(?: version)?)?
gpl | 1 | 0.95 | gpl | (?:licensed|licenced|released|distributed|available|provided|published|offered|shared) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: version| v)?(?: [123](?: 0)?)?(?: or (?:any )?(?:later|newer)(?: version)?)?
gpl | 1 | 0.95 | gplv2 gplv3 gpl2 gpl3 | (?:licensed|licenced|released|distributed|available|provided|published|offered|shared) under (?:the )?(?:gnu )?gplv?[23](?: 0)?(?: or later)?
gpl | 1 | 0.95 | general | (?:subject to|governed by|covered by|according to) (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e
gpl | 1 | 0.9 | gpl | gpl compatible
lgpl | 1 | 0.98 | lesser library | (?:licensed|licenced|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)?(?: [23](?: [01])?)?(?: or (?:any )?(?:later|newer)(?: version)?)?
lgpl | 1 | 0.95 | lgpl lgplv2 lgplv3 | (?:licensed|licenced|released|distributed|available) under (?:the )?(?:gnu )?lgpl(?:v?[23])?(?: [23](?: [01])?)?(?: or later)?
agpl | 1 | 0.98 | affero | (?:licensed|licenced|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[cs]e(?: version| v)?(?: [13](?: 0)?)?(?: or (?:any )?(?:later|newer)(?: version)?)?
agpl | 1 | 0.95 | agpl agplv3 agpl3 | (?:licensed|licenced|released|distributed|available) under (?:the )?(?:gnu )?agpl(?:v?3)?(?: 3(?: 0)?)?(?: or later)?
bsd | 1 | 0.98 | bsd | (?:licensed|licenced|released|distributed|available|provided|published) under (?:the |a )?(?:terms of )?(?:the )?(?:[234] clause |new |modified |simplified |revised )?bsd(?: style)?(?: [234] clause)?(?: licen[cs]e)?
mpl | 1 | 0.98 | mozilla mpl | (?:licensed|licenced|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:mozilla public licen[cs]e|mpl)(?: version| v)?(?: [12] [01])?
epl | 1 | 0.98 | eclipse epl | (?:licensed|licenced|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:eclipse public licen[cs]e|epl)(?: version| v)?(?: [12] 0)?
isc | 1 | 0.98 | isc | (?:licensed|licenced|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?
zlib | 1 | 0.95 | zlib | (?:licensed|licenced|released|distributed|available) under (?:the )?zlib(?: libpng)?(?: licen[cs]e)?
boost | 1 | 0.98 | boost | (?:licensed|licenced|released|distributed|available) under (?:the )?boost software licen[cs]e(?: version| v)?(?: 1 0)?
artistic | 1 | 0.95 | artistic | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:perl )?artistic licen[cs]e(?: [12] 0)?
unlicense | 1 | 0.98 | unlicense | (?:licensed|released|distributed|available) under (?:the )?unlicense
wtfpl | 1 | 0.95 | wtfpl | (?:licensed|released|distributed|available) under (?:the )?wtfpl
cc-by | 1 | 0.98 | attribution | (?:licensed|licenced|released|available|published|shared) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa | 1 | 0.98 | sharealike alike | (?:licensed|licenced|released|available|published|shared) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc | 1 | 0.98 | noncommercial commercial | (?:licensed|licenced|released|available|published|shared) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution non ?commercial(?: share ?alike| no ?derivatives| no ?derivs)?(?: [1234] [05])?
cc-by-nd | 1 | 0.98 | noderivatives derivatives noderivs | (?:licensed|licenced|released|available|published|shared) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?
cc-by | 1 | 0.95 | by | (?:licensed|released|available|published) under (?:a |the )?cc by(?: [1234] [05])?
cc-by-sa | 1 | 0.95 | sa | (?:licensed|released|available|published) under (?:a |the )?cc by sa(?: [1234] [05])?
cc0 | 1 | 0.98 | cc0 | (?:licensed|released|available|published|dedicated) (?:under|to|with) (?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0 | 1 | 0.95 | zero | (?:licensed|released|available) under (?:the )?creative commons zero
public-domain | 1 | 0.95 | domain | (?:released|placed|dedicated|put|published|donated|given) (?:in|into|to|under) (?:the )?public domain
public-domain | 1 | 0.95 | domain | (?:this|the) (?:work|file|code|software|text|program|document|image|book) (?:is|has been|was) (?:now )?(?:released |placed |dedicated )?(?:in|into|to) the public domain
public-domain | 1 | 0.9 | domain | (?:is|are|in) (?:in )?the public domain
proprietary | 1 | 0.95 | proprietary | (?:licensed|released|distributed|available) under a (?:commercial|proprietary) licen[cs]e
proprietary | 2 | 0.8 | reserved | all rights reserved
eupl | 1 | 0.98 | european | (?:licensed|released|distributed) under (?:the )?european union public licen[cs]e(?: v)?(?: 1 [12])?
ofl | 1 | 0.95 | ofl font | (?:licensed|released|available) under (?:the )?(?:sil )?(?:ofl|open font licen[cs]e)(?: 1 [01])?
postgresql | 1 | 0.95 | postgresql | (?:licensed|released) under (?:the )?postgresql licen[cs]e
python | 1 | 0.95 | python psf | (?:licensed|released|distributed) under (?:the )?(?:python software foundation|psf) licen[cs]e
odbl | 1 | 0.95 | odbl database | (?:licensed|released|available) under (?:the )?(?:odbl|open (?:data commons open )?database licen[cs]e)
gfdl | 1 | 0.95 | documentation gfdl | (?:licensed|released|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu free documentation licen[cs]e|gfdl)
mit | 2 | 0.9 | mit | licen[cs]e (?:type |name |text |file )?(?:is )?(?:the )?mit
mit | 2 | 0.9 | osi | licen[cs]e osi approved mit licen[cs]e
apache | 2 | 0.9 | apache | licen[cs]e (?:type |name |text |file )?(?:is )?(?:the )?apache(?: licen[cs]e)?(?: version| v)?(?: 2 0| 2| 1 1)?
apache | 2 | 0.9 | osi | licen[cs]e osi approved apache software licen[cs]e
gpl | 2 | 0.9 | gpl gplv2 gplv3 gpl2 gpl3 | licen[cs]e (?:type |name |text |file )?(?:is )?(?:the )?(?:gnu )?gpl(?:v?[123])?(?: [123](?: 0)?)?(?: only| or later)?
gpl | 2 | 0.9 | osi | licen[cs]e osi approved gnu general public licen[cs]e(?: v[23])?(?: or later)?
lgpl | 2 | 0.9 | lgpl lgplv2 lgplv3 | licen[cs]e (?:type |name |text |file )?(?:is )?(?:the )?(?:gnu )?lgpl(?:v?[23])?(?: [23](?: [01])?)?(?: only| or later)?
lgpl | 2 | 0.9 | osi | licen[cs]e osi approved gnu lesser general public licen[cs]e
agpl | 2 | 0.9 | agpl agplv3 | licen[cs]e (?:type |name |text |file )?(?:is )?(?:the )?(?:gnu )?agpl(?:v?3)?(?: 3(?: 0)?)?(?: only| or later)?
agpl | 2 | 0.9 | osi | licen[cs]e osi approved gnu affero general public licen[cs]e
bsd | 2 | 0.9 | bsd | licen[cs]e (?:type |name |text |file )?(?:is )?(?:the )?(?:new |modified |simplified )?bsd(?: [0234] clause)?
bsd | 2 | 0.9 | osi | licen[cs]e osi approved bsd licen[cs]e
mpl | 2 | 0.9 | mpl | licen[cs]e (?:type |name )?(?:is )?(?:the )?mpl(?: [12] [01])?
mpl | 2 | 0.9 | osi | licen[cs]e osi approved mozilla public licen[cs]e
isc | 2 | 0.9 | isc | licen[cs]e (?:type |name )?(?:is )?(?:the )?isc
isc | 2 | 0.9 | osi | licen[cs]e osi approved isc licen[cs]e
epl | 2 | 0.9 | epl | licen[cs]e (?:type |name )?(?:is )?(?:the )?epl(?: [12] 0)?
zlib | 2 | 0.9 | zlib | licen[cs]e (?:type |name )?(?:is )?zlib
boost | 2 | 0.9 | bsl | licen[cs]e (?:type |name )?(?:is )?bsl 1 0
unlicense | 2 | 0.9 | unlicense | licen[cs]e (?:type |name )?(?:is )?(?:the )?unlicense
unlicense | 2 | 0.9 | osi | licen[cs]e osi approved the unlicense
wtfpl | 2 | 0.9 | wtfpl | licen[cs]e (?:type |name )?(?:is )?wtfpl
artistic | 2 | 0.9 | artistic | licen[cs]e (?:type |name )?(?:is )?artistic(?: [12] 0)?
cc0 | 2 | 0.9 | cc0 | licen[cs]e (?:type |name )?(?:is )?cc0(?: 1 0)?
cc-by | 2 | 0.9 | cc | licen[cs]e (?:type |name )?(?:is )?cc by(?: [1234] [05])?
cc-by-sa | 2 | 0.9 | sa | licen[cs]e (?:type |name )?(?:is )?cc by sa(?: [1234] [05])?
cc-by-nc | 2 | 0.9 | nc | licen[cs]e (?:type |name )?(?:is )?cc by nc(?: sa| nd)?(?: [1234] [05])?
cc-by-nd | 2 | 0.9 | nd | licen[cs]e (?:type |name )?(?:is )?cc by nd(?: [1234] [05])?
proprietary | 2 | 0.9 | proprietary unlicensed | licen[cs]e (?:type |name )?(?:is )?(?:proprietary|unlicensed)
public-domain | 2 | 0.9 | domain | licen[cs]e (?:type |name )?(?:is )?public domain
public-domain | 2 | 0.9 | osi domain | licen[cs]e public domain
apache | 2 | 0.95 | org | (?:www )?apache org licenses license 2 0
mit | 2 | 0.95 | org | opensource org licenses? mit(?: license)?
bsd | 2 | 0.95 | org | opensource org licenses? bsd(?: [23] clause| license)?
gpl | 2 | 0.95 | org | (?:www )?gnu org licenses (?:old licenses )?gpl(?: [23] 0)?
lgpl | 2 | 0.95 | org | (?:www )?gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?
agpl | 2 | 0.95 | org | (?:www )?gnu org licenses agpl(?: 3 0)?
gfdl | 2 | 0.95 | org | (?:www )?gnu org licenses (?:old licenses )?fdl(?: 1 [123])?
mpl | 2 | 0.95 | org | (?:www )?mozilla org mpl(?: mpl)?(?: [12] [01])?
epl | 2 | 0.95 | org | (?:www )?eclipse org legal epl(?: v10| v20| 2 0)?
boost | 2 | 0.95 | org | (?:www )?boost org license 1 0 txt
unlicense | 2 | 0.95 | org | (?:www )?unlicense org
cc-by | 2 | 0.95 | creativecommons | creativecommons org licenses by [1234] [05]
cc-by-sa | 2 | 0.95 | creativecommons | creativecommons org licenses by sa [1234] [05]
cc-by-nc | 2 | 0.95 | creativecommons | creativecommons org licenses by nc(?: sa| nd)? [1234] [05]
cc-by-nd | 2 | 0.95 | creativecommons | creativecommons org licenses by nd [1234] [05]
cc0 | 2 | 0.95 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 2 | 0.95 | creativecommons | creativecommons org publicdomain mark 1 0
ofl | 2 | 0.95 | sil | scripts sil org ofl
mit | 3 | 0.7 | mit | mit licen[cs]e
mit | 3 | 0.7 | mit | mit licen[cs]ed
mit | 3 | 0.7 | expat | expat licen[cs]e
mit | 3 | 0.7 | mit | mit x11(?: licen[cs]e)?
mit-0 | 3 | 0.75 | mit | mit (?:no attribution|0) licen[cs]e
x11 | 3 | 0.7 | x11 | x11 licen[cs]e
apache | 3 | 0.7 | apache | apache(?: software| public)? licen[cs]e(?: version| v)?(?: 2 0| 2| 1 1| 1 0)?
apache | 3 | 0.7 | apache | apache 2(?: 0)? licen[cs]ed?
gpl | 3 | 0.7 | general | (?:gnu )?general public licen[cs]e(?: version| v)?(?: [123](?: 0)?)?(?: or (?:any )?(?:later|newer)(?: version)?)?
gpl | 3 | 0.7 | gpl | gnu gpl(?: version| v)?(?: [123](?: 0)?)?(?: or (?:any )?later(?: version)?)?
gpl | 3 | 0.7 | gpl | gpl licen[cs]ed?
gpl | 3 | 0.75 | gplv1 gplv2 gplv3 | (?:gnu )?gplv[123](?: or later)?
gpl | 3 | 0.75 | gpl | gpl (?:version |v )?[123] 0(?: only| or later)?
lgpl | 3 | 0.7 | lesser library | (?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)?(?: [23](?: [01])?)?(?: or (?:any )?later(?: version)?)?
lgpl | 3 | 0.7 | lgpl | gnu lgpl
lgpl | 3 | 0.75 | lgplv2 lgplv3 | (?:gnu )?lgplv[23](?: 1)?(?: or later)?
lgpl | 3 | 0.75 | lgpl | lgpl (?:version |v )?[23] [01](?: only| or later)?
agpl | 3 | 0.7 | affero | (?:gnu )?affero general public licen[cs]e(?: version| v)?(?: [13](?: 0)?)?(?: or (?:any )?later(?: version)?)?
agpl | 3 | 0.7 | agpl | gnu agpl
agpl | 3 | 0.75 | agplv3 | (?:gnu )?agplv3(?: or later)?
agpl | 3 | 0.75 | agpl | agpl 3 0(?: only| or later)?
gfdl | 3 | 0.7 | documentation | gnu free documentation licen[cs]e(?: version)?(?: 1 [123])?
bsd | 3 | 0.7 | bsd | bsd(?: style)? licen[cs]ed?
bsd | 3 | 0.75 | bsd | bsd [0234] clause(?: licen[cs]e)?
bsd | 3 | 0.75 | bsd | (?:two|three|four|[234]) clause bsd(?: licen[cs]e)?
bsd | 3 | 0.7 | bsd | (?:new|modified|simplified|revised|original) bsd licen[cs]e
bsd | 3 | 0.7 | berkeley | berkeley software distribution licen[cs]e
mpl | 3 | 0.7 | mozilla | mozilla public licen[cs]e(?: version| v)?(?: [12] [01])?
mpl | 3 | 0.75 | mpl | mpl (?:v |version )?[12] [01]
epl | 3 | 0.7 | eclipse | eclipse public licen[cs]e(?: version| v)?(?: [12] 0)?
epl | 3 | 0.75 | epl | epl [12] 0
edl | 3 | 0.7 | eclipse | eclipse distribution licen[cs]e(?: 1 0)?
cddl | 3 | 0.7 | development | common development and distribution licen[cs]e(?: version)?(?: 1 [01])?
cddl | 3 | 0.75 | cddl | cddl 1 [01]
cpl | 3 | 0.7 | common | common public licen[cs]e(?: version)?(?: 1 0)?
ipl | 3 | 0.7 | ibm | ibm public licen[cs]e(?: 1 0)?
isc | 3 | 0.7 | isc | isc licen[cs]e
zlib | 3 | 0.7 | zlib | zlib(?: libpng)? licen[cs]e
boost | 3 | 0.7 | boost | boost software licen[cs]e(?: version)?(?: 1 0)?
artistic | 3 | 0.7 | artistic | (?:perl )?artistic licen[cs]e(?: [12] 0)?
unlicense | 3 | 0.7 | unlicense | (?:the )?unlicense
wtfpl | 3 | 0.7 | wtfpl | wtfpl
wtfpl | 3 | 0.8 | fuck | do what the fuck you want to public licen[cs]e
cc0 | 3 | 0.7 | cc0 | cc0(?: 1 0)?(?: universal| licen[cs]e)?
cc0 | 3 | 0.7 | zero | creative commons zero
cc-by | 3 | 0.7 | attribution | creative commons attribution(?: [1234] [05])?(?: international| unported)?
cc-by | 3 | 0.7 | cc | cc by(?: [1234] [05])?
cc-by-sa | 3 | 0.75 | sharealike alike | creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?
cc-by-sa | 3 | 0.75 | sa | cc by sa(?: [1234] [05])?
cc-by-nc | 3 | 0.75 | noncommercial commercial | creative commons attribution non ?commercial(?: share ?alike| no ?deriv(?:ative)?s)?(?: [1234] [05])?
cc-by-nc | 3 | 0.75 | nc | cc by nc(?: sa| nd)?(?: [1234] [05])?
cc-by-nd | 3 | 0.75 | nd | cc by nd(?: [1234] [05])?
cc-by-nd | 3 | 0.75 | noderivatives noderivs derivatives | creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?
eupl | 3 | 0.7 | european | european union public licen[cs]e(?: v)?(?: 1 [12])?
eupl | 3 | 0.75 | eupl | eupl 1 [12]
ofl | 3 | 0.7 | font | (?:sil )?open font licen[cs]e(?: 1 [01])?
python | 3 | 0.7 | python psf | (?:python software foundation|psf) licen[cs]e(?: 2)?
postgresql | 3 | 0.7 | postgresql | postgresql licen[cs]e
ms-pl | 3 | 0.7 | microsoft | microsoft public licen[cs]e
ms-rl | 3 | 0.7 | microsoft | microsoft reciprocal licen[cs]e
openssl | 3 | 0.7 | openssl | openssl licen[cs]e
ncsa | 3 | 0.7 | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
ruby | 3 | 0.7 | ruby | ruby licen[cs]e
php | 3 | 0.7 | php | php licen[cs]e(?: version)?(?: 3 01?)?
vim | 3 | 0.7 | vim | vim licen[cs]e
beerware | 3 | 0.7 | beer beerware | beer ?ware licen[cs]e
json | 3 | 0.7 | json | json licen[cs]e
odbl | 3 | 0.7 | database | open (?:data commons open )?database licen[cs]e
busl | 3 | 0.7 | business | business source licen[cs]e(?: 1 1)?
sspl | 3 | 0.7 | side sspl | (?:server side public licen[cs]e|sspl)(?: v?1)?
elastic | 3 | 0.7 | elastic | elastic licen[cs]e(?: 2 0)?
openrail | 3 | 0.7 | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?
tex | 3 | 0.7 | latex | latex project public licen[cs]e
w3c | 3 | 0.7 | w3c | w3c software(?: notice and)? licen[cs]e
qpl | 3 | 0.7 | q | q public licen[cs]e
afl | 3 | 0.7 | academic | academic free licen[cs]e(?: version)?(?: [123] [01])?
osl | 3 | 0.7 | open | open software licen[cs]e(?: version)?(?: [123] 0)?
upl | 3 | 0.7 | universal | universal permissive licen[cs]e
mulan | 3 | 0.7 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: v?2)?
"""
#: label: identifiers in tags and expressions (SPDX), in normalised words
TAGS = """
mit: mit; mit-0: mit 0; apache: apache 2 0, apache 1 1, apache 1 0; gpl: gpl 1 0, gpl 2 0, gpl 3 0; lgpl: lgpl 2 0, lgpl 2 1, lgpl 3 0; agpl: agpl 1 0, agpl 3 0; bsd: 0bsd, bsd 1 clause, bsd 2 clause, bsd 3 clause, bsd 4 clause;
mpl: mpl 1 0, mpl 1 1, mpl 2 0; epl: epl 1 0, epl 2 0; cddl: cddl 1 0, cddl 1 1; isc: isc; zlib: zlib; boost: bsl 1 0; artistic: artistic 1 0, artistic 2 0; unlicense: unlicense; wtfpl: wtfpl; cc0: cc0 1 0;
cc-by: cc by 1 0, cc by 2 0, cc by 2 5, cc by 3 0, cc by 4 0; cc-by-sa: cc by sa 1 0, cc by sa 2 0, cc by sa 2 5, cc by sa 3 0, cc by sa 4 0; cc-by-nc: cc by nc 2 0, cc by nc 3 0, cc by nc 4 0, cc by nc sa 3 0, cc by nc sa 4 0, cc by nc nd 3 0, cc by nc nd 4 0;
cc-by-nd: cc by nd 3 0, cc by nd 4 0; eupl: eupl 1 0, eupl 1 1, eupl 1 2; ofl: ofl 1 0, ofl 1 1; python: psf 2 0, python 2 0; postgresql: postgresql; ms-pl: ms pl; ms-rl: ms rl; openssl: openssl; ncsa: ncsa; ruby: ruby; php: php 3 01; vim: vim;
beerware: beerware; json: json; odbl: odbl 1 0; busl: busl 1 1; sspl: sspl 1 0; elastic: elastic 2 0; gfdl: gfdl 1 1, gfdl 1 2, gfdl 1 3; x11: x11; tex: lppl 1 3c; afl: afl 3 0; osl: osl 3 0; upl: upl 1 0; mulan: mulanpsl 2 0; w3c: w3c
"""


#: words on either side of a keyword that a match can take
REACH = 120


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules, strongest first."""
    out = []

    def rule(label, priority, confidence, keywords, expression):
        out.append(Rule(label, priority, confidence, tuple(k.encode() for k in keywords), re.compile(rf"(?<![^ ])(?:{expression})(?![^ ])".encode())))

    for line in SIGNATURES.strip().split("\n"):
        label, priority, confidence, keywords, expression = line.split(" | ")
        rule(label, int(priority), float(confidence), keywords.split(), expression)
    for entry in TAGS.replace("\n", " ").strip().split(";"):
        label, ids = entry.strip().split(": ")
        for words in ids.split(", "):
            # an identifier of an expression: after the tag there may be others, joined by and, or, with; each detection is its own identifier
            rule(label, 1, 0.99, ["spdx"], rf"spdx licen[cs]e identifier (?:(?:\S+ ){{1,6}}(?:and|or|with) ){{0,4}}?(?P<own>{words}(?: only| or later)?)")
    return sorted(out, key=lambda r: r.priority)


class Scanner:
    """Rules by keyword. REACH words around each keyword of a rule are searched, which no match exceeds by itself; windows that overlap are one."""

    def __init__(self):
        self.rules = rules()
        self.by_keyword = defaultdict(list)
        for i, rule in enumerate(self.rules):
            for k in rule.keywords:
                self.by_keyword[k].append(i)
        self.phrases = [(tuple(w.encode() for w in words), label) for words, label in PHRASES]
        self.gate = frozenset(self.by_keyword) | {b"license"}

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of each place of a phrase."""
        out, at = [], -1
        while True:
            try:
                at = words.index(b"license", at + 1)
            except ValueError:
                return out
            for phrase, label in self.phrases:
                start = at + 1 - len(phrase)
                if start >= 0 and tuple(words[start : at + 1]) == phrase:
                    out.append((start, label))

    def found(self, words: list[bytes], gated: bool = True) -> set[tuple[int, int, str, int, float]]:
        """All matches of rules (start, end, label, priority, confidence); gated=False tries every rule on the whole text."""
        line = b" ".join(words)
        begins = [0, *itertools.accumulate(len(w) + 1 for w in words)]
        windows: dict[int, list[tuple[int, int]]] = {}
        if gated:
            places: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(words):
                if w in self.by_keyword:
                    places[w].append(i)
            held: dict[int, list[int]] = defaultdict(list)
            for k, at in places.items():
                for i in self.by_keyword[k]:
                    held[i] += at
            for i, at in held.items():
                spans: list[list[int]] = []
                for p in sorted(at):
                    if spans and p - REACH <= spans[-1][1]:
                        spans[-1][1] = p + REACH
                    else:
                        spans.append([max(0, p - REACH), p + REACH])
                windows[i] = [(begins[a], begins[min(b, len(words))]) for a, b in spans]
        out = set()
        for i, spans in windows.items() if gated else ((i, [(0, len(line) + 1)]) for i in range(len(self.rules))):
            rule = self.rules[i]
            for a, b in spans:
                for m in rule.pattern.finditer(line, a, b - 1 if b <= len(line) else len(line)):
                    start, end = m.span("own") if rule.pattern.groupindex else m.span()
                    out.add((bisect.bisect_left(begins, start), bisect.bisect_left(begins, end), rule.label, rule.priority, rule.confidence))
        return out

    def detections(self, words: list[bytes], gated: bool = True) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, priority, confidence) of what is left after suppression, by start."""
        if gated and self.gate.isdisjoint(words):
            return []
        kept = []
        # strongest first; within a priority the longer first, so that what is suppressed comes after what suppresses it. Of the intervals kept, those that
        # no other holds: both their starts and their ends rise, so the last that begins no later decides
        low: list[int] = []
        high: list[int] = []
        for d in sorted(self.found(words, gated), key=lambda d: (d[3], d[0] - d[1], d[0], d[2], -d[4])):
            at = bisect.bisect_right(low, d[0])
            if at and high[at - 1] >= d[1]:
                continue
            kept.append(d)
            gone = at
            at = bisect.bisect_left(low, d[0])
            while gone < len(low) and high[gone] <= d[1]:
                gone += 1
            low[at:gone], high[at:gone] = [d[0]], [d[1]]
        return sorted(kept)


def _scan(batches):
    import pyarrow as pa

    scanner = Scanner()
    for batch in batches:
        out = defaultdict(list)
        for doc_id, text in rows([batch], "doc_id", "text"):
            plain = text.translate(PLAIN)
            words = plain.split()
            base, found = ([], []) if scanner.gate.isdisjoint(words) else (scanner.base(words), scanner.detections(words))
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(words))
            out["places"].append([{"start": s, "label": x} for s, x in base])
            out["detections"].append([{"start": s, "end": e, "label": x, "priority": p, "confidence": c} for s, e, x, p, c in found])
        place = pa.struct([("start", pa.int64()), ("label", pa.string())])
        detection = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["places"], pa.list_(place)), pa.array(out["detections"], pa.list_(detection))],
            ["doc_id", "n_words", "places", "detections"],
        )


def scan(documents: DataFrame) -> DataFrame:
    """For each document: doc_id, n_words, places (start, label) of base phrases, and detections (start, end in words,
    label, priority, confidence) that no stronger one contains."""
    ship(documents.sparkSession)
    return texts(documents).mapInArrow(
        _scan,
        "doc_id long, n_words long, places array<struct<start:long,label:string>>, detections array<struct<start:long,end:long,label:string,priority:int,confidence:double>>",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: licenses in every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_sort(F.array_distinct("places.label"))
    labels = F.array_sort(F.array_distinct(F.concat("places.label", "detections.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(F.size("places") > 0, 0.7).otherwise(0.0)).alias("score"),
    )
