"""Hand-written licence signatures, in order of priority.

They are read on normalised text: lower-case words of letters and digits parted by single spaces.
Each line: label, keyword that gates the rule (the start of words that every match holds), regular expression. The strength of a rule's section
says how sure one match makes the reader. Earlier rules suppress later ones inside their interval."""

from __future__ import annotations

#: Sentences of the licence texts themselves.
TEXTS = r"""
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy (?:\w+ ){5,60}to whom the software is furnished to do so(?! subject)
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | permission to use copy modify | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
0bsd | permission to use copy modify | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)
hpnd | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose
ntp | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | endorse or promote | neither the name of (?:\w+ ){1,12}nor the names of (?:its|any) contributors may be used to endorse or promote products
bsd-3-clause | endorse or promote | the names? of (?:\w+ ){1,12}may not be used to endorse or promote products
bsd-2-clause | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause-patent | each copyright holder and contributor | subject to the terms and conditions of this license each copyright holder and contributor hereby grants
apache-2.0 | reproduction and distribution 1 definitions | terms and conditions for use reproduction and distribution 1 definitions
apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | grant of copyright license | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants
apache-2.0 | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
gpl-3.0 | gnu general public license | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2.0 | most software are designed | the licenses for most software are designed to take away your freedom to share and change it
gpl | free software foundation | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl | gnu general public license | you should have received a copy of the gnu general public license along with this
gpl | warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | warranty | comes with absolutely no warranty(?: for details type show w)?
lgpl | lesser general public license | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | lesser general public license | you should have received a copy of the gnu lesser general public license
lgpl-2.0 | library general public license | under the terms of the gnu library general public license
lgpl-3.0 | lesser general public license | this version of the gnu lesser general public license incorporates the terms and conditions of version 3
agpl-3.0 | affero general public license | the gnu affero general public license is a free copyleft license
agpl-3.0 | affero general public license | under the terms of the gnu affero general public license
gfdl | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | mozilla | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | netscape | the contents of this file are subject to the netscape public license
cddl-1.0 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
epl-1.0 | eclipse public license | the accompanying program is provided under the terms of this eclipse public license
epl-2.0 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license
cpl-1.0 | common public license | the accompanying program is provided under the terms of this common public license
ipl-1.0 | ibm public license | the accompanying program is provided under the terms of this ibm public license
eupl-1.2 | eupl version 1 | licensed under the eupl version 1 2
eupl-1.1 | eupl version 1 | licensed under the eupl version 1 1
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | png reference library | the png reference library is supplied as is
bsl-1.0 | any person or organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | public domain | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 | dedicated the work | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | affirmer hereby | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
wtfpl | what the | you just do what the \w+ you want to
wtfpl | everyone is permitted | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
fsf-notice | everyone is permitted | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
artistic-1.0 | intent of this document | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | given free software package | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
ofl-1.1 | font software | permission is hereby granted free of charge to any person obtaining a copy of the font software
python-2.0 | python software foundation | python software foundation license version 2
python-2.0 | psf hereby grants | psf hereby grants licensee a nonexclusive royalty free world wide license
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | eric young | this product includes cryptographic software written by eric young
curl | permission to use copy modify | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
icu | unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
php-3.01 | php | this product includes php software freely available from
ruby | verbatim copies of the source form | you may make and give away verbatim copies of the source form of the software without restriction
vim | vim | there are no restrictions on distributing unmodified copies of vim
w3c | by obtaining using and or copying | by obtaining using and or copying this work you the licensee agree
afl-3.0 | academic free license | licensed under the academic free license version 3 0
osl-3.0 | open software license | licensed under the open software license version 3 0
ms-pl | license governs use | this license governs use of the accompanying software if you use the software you accept this license
beerware | beer | you can buy me a beer in return
json | good not evil | the software shall be used for good not evil
postgresql | documentation for any purpose | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
nasa-1.3 | open source agreement agreement | this open source agreement agreement defines the rights of use
upl-1.0 | universal permissive | the universal permissive license upl
sspl-1.0 | server side public | server side public license version 1
busl-1.1 | the licensor hereby grants | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2.0 | third parties as a hosted | you may not provide the software to third parties as a hosted or managed service
commons-clause | the grant of rights under | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
mulan-psl-2.0 | each contributor hereby grants | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide royalty free
warranty-disclaimer | as is | the software is provided as is without warranty of any kind express or implied
warranty-disclaimer | as is | this software is provided by the copyright holders and contributors as is
warranty-disclaimer | as is | this software is provided as is without any express or implied warranty
"""

#: Sentences that put a work under a licence.
NOTICES = r"""
apache-2.0 | apache licen | licen[sc]ed under the apache licen[sc]e (?:version |v )?2(?: 0)?
apache-1.1 | apache licen | licen[sc]ed under the apache licen[sc]e (?:version |v )?1 1
apache | apache licen | licen[sc]ed under the apache licen[sc]e
mit | mit licen | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?mit licen[sc]e
mit | mit licence | (?:licen[sc]ed|released|distributed|available|published) under the (?:terms of the )?mit licence
gpl-3.0 | general public license | licen[sc]ed under the gnu general public license (?:version |v )?3(?: 0)?
gpl-2.0 | general public license | licen[sc]ed under the gnu general public license (?:version |v )?2(?: 0)?
gpl | general public license | (?:licen[sc]ed|released|distributed) under the (?:terms of the )?gnu general public license
gpl-3.0-or-later | or at your option | (?:either )?version 3 of the license or at your option any later version
gpl-2.0-or-later | or at your option | (?:either )?version 2 of the license or at your option any later version
lgpl-2.1-or-later | or at your option | (?:either )?version 2 1 of the license or at your option any later version
lgpl-3.0 | lesser general public | licen[sc]ed under the gnu lesser general public license (?:version |v )?3
lgpl-2.1 | lesser general public | licen[sc]ed under the gnu lesser general public license (?:version |v )?2 1
lgpl | lesser general public | (?:licen[sc]ed|released|distributed) under the (?:terms of the )?gnu lesser general public license
agpl-3.0 | affero | (?:licen[sc]ed|released|distributed) under the (?:terms of the )?(?:gnu )?affero general public license
bsd | bsd | (?:licen[sc]ed|released|distributed) under (?:the |a )?(?:terms of the )?bsd (?:style )?licen[sc]e
bsd-3-clause | bsd | (?:licen[sc]ed|released|distributed) under the (?:3 clause|new|modified|revised) bsd licen[sc]e
bsd-2-clause | bsd | (?:licen[sc]ed|released|distributed) under the (?:2 clause|simplified) bsd licen[sc]e
cc-by-nc-nd-4.0 | cc by nc nd | licen[sc]ed under (?:the )?cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa | licen[sc]ed under (?:the )?cc by nc sa 4 0
cc-by-nc-4.0 | cc by nc | licen[sc]ed under (?:the )?cc by nc 4 0
cc-by-nd-4.0 | cc by nd | licen[sc]ed under (?:the )?cc by nd 4 0
cc-by-sa-4.0 | cc by sa | licen[sc]ed under (?:the )?cc by sa 4 0
cc-by-sa-3.0 | cc by sa | licen[sc]ed under (?:the )?cc by sa 3 0
cc-by-4.0 | cc by | licen[sc]ed under (?:the )?cc by 4 0
cc-by-3.0 | cc by | licen[sc]ed under (?:the )?cc by 3 0
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc | creative commons | creative commons attribution non ?commercial
cc-by-sa | creative commons | creative commons attribution share ?alike
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s?
cc-by | creative commons | creative commons attribution
cc0-1.0 | creative commons | creative commons (?:zero|cc0)
cc | creative commons | licen[sc]ed under a creative commons licen[sc]e
mpl-2.0 | mozilla public | (?:licen[sc]ed|released|available) under the mozilla public license (?:version |v )?2
mpl | mozilla public | (?:licen[sc]ed|released|available) under the mozilla public license
epl-2.0 | eclipse public | (?:licen[sc]ed|released|available) under the eclipse public license (?:version |v )?2
epl-1.0 | eclipse public | (?:licen[sc]ed|released|available) under the eclipse public license (?:version |v )?1
cddl | cddl | (?:licen[sc]ed|released|available) under the cddl
eupl | eupl | (?:licen[sc]ed|released|available) under the eupl
isc | isc licen | (?:licen[sc]ed|released|distributed) under the isc licen[sc]e
zlib | zlib | (?:licen[sc]ed|released|distributed) under the zlib(?: libpng)? licen[sc]e
bsl-1.0 | boost software | distributed under the boost software license version 1 0
unlicense | unlicense | (?:licen[sc]ed|released|dedicated) (?:to the public domain )?under the unlicense
wtfpl | wtfpl | (?:licen[sc]ed|released|distributed) under the wtfpl
artistic-2.0 | artistic license | (?:licen[sc]ed|released|distributed) under the artistic license 2 0
perl | perl itself | under the same terms as perl itself
ofl-1.1 | sil open font | licen[sc]ed under the sil open font license version 1 1
ofl-1.1 | sil open font | licen[sc]ed under the sil open font license
odbl-1.0 | open database license | (?:licen[sc]ed|available) under the open database license
odc-by | open data commons attribution | open data commons attribution license
pddl | public domain dedication | public domain dedication and license
ogl-uk-3.0 | open government licence | open government licence v(?:ersion)? ?3 0
ogl-uk | open government licence | licen[sc]ed under the open government licence
public-domain | public domain | (?:released|dedicated|placed) (?:in)?to the public domain
public-domain | public domain | this (?:work|file|code|software|image) is in the public domain
public-domain | public domain | no rights reserved public domain
all-rights-reserved | all rights reserved | all rights reserved
proprietary | confidential | proprietary and confidential
proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) of this \w+
proprietary | trade secret | contains trade secrets? (?:\w+ ){0,6}confidential
proprietary | written permission | without (?:the )?(?:prior )?(?:express )?written permission of
non-commercial | for non | for non ?commercial (?:use|purposes) only
non-commercial | noncommercial | for noncommercial (?:use|purposes) only
research-only | research purposes | for research purposes only
personal-use | personal use | for personal use only
no-redistribution | redistribut | (?:may|must) not be redistributed
dual-license | dual licen | dual licen[sc]ed under
"""

#: Machine-readable identifiers.
TAGS = r"""
apache-2.0 | spdx license identifier | spdx license identifier apache 2 0
apache-1.1 | spdx license identifier | spdx license identifier apache 1 1
mit-0 | spdx license identifier | spdx license identifier mit 0
mit | spdx license identifier | spdx license identifier mit
gpl-3.0-or-later | spdx license identifier | spdx license identifier gpl 3 0 (?:or later|plus)
gpl-3.0-only | spdx license identifier | spdx license identifier gpl 3 0(?: only)?
gpl-2.0-or-later | spdx license identifier | spdx license identifier gpl 2 0 (?:or later|plus)
gpl-2.0-only | spdx license identifier | spdx license identifier gpl 2 0(?: only)?
lgpl-3.0-or-later | spdx license identifier | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | spdx license identifier | spdx license identifier lgpl 3 0(?: only)?
lgpl-2.1-or-later | spdx license identifier | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | spdx license identifier | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.0 | spdx license identifier | spdx license identifier lgpl 2 0(?: only| or later)?
agpl-3.0-or-later | spdx license identifier | spdx license identifier agpl 3 0 or later
agpl-3.0-only | spdx license identifier | spdx license identifier agpl 3 0(?: only)?
bsd-2-clause | spdx license identifier | spdx license identifier bsd 2 clause
bsd-3-clause | spdx license identifier | spdx license identifier bsd 3 clause
bsd-4-clause | spdx license identifier | spdx license identifier bsd 4 clause
0bsd | spdx license identifier | spdx license identifier 0bsd
isc | spdx license identifier | spdx license identifier isc
zlib | spdx license identifier | spdx license identifier zlib
mpl-2.0 | spdx license identifier | spdx license identifier mpl 2 0
mpl-1.1 | spdx license identifier | spdx license identifier mpl 1 1
epl-2.0 | spdx license identifier | spdx license identifier epl 2 0
epl-1.0 | spdx license identifier | spdx license identifier epl 1 0
cddl-1.0 | spdx license identifier | spdx license identifier cddl 1 0
cddl-1.1 | spdx license identifier | spdx license identifier cddl 1 1
eupl-1.2 | spdx license identifier | spdx license identifier eupl 1 2
eupl-1.1 | spdx license identifier | spdx license identifier eupl 1 1
bsl-1.0 | spdx license identifier | spdx license identifier bsl 1 0
unlicense | spdx license identifier | spdx license identifier unlicense
cc0-1.0 | spdx license identifier | spdx license identifier cc0 1 0
cc-by-4.0 | spdx license identifier | spdx license identifier cc by 4 0
cc-by-3.0 | spdx license identifier | spdx license identifier cc by 3 0
cc-by-sa-4.0 | spdx license identifier | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx license identifier | spdx license identifier cc by nc 4 0
artistic-2.0 | spdx license identifier | spdx license identifier artistic 2 0
python-2.0 | spdx license identifier | spdx license identifier (?:python|psf) 2 0
postgresql | spdx license identifier | spdx license identifier postgresql
ofl-1.1 | spdx license identifier | spdx license identifier ofl 1 1
ncsa | spdx license identifier | spdx license identifier ncsa
wtfpl | spdx license identifier | spdx license identifier wtfpl
cc0-1.0 | creativecommons org | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org | creativecommons org publicdomain mark 1 0
cc-by-nc-sa-4.0 | creativecommons org | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-3.0 | creativecommons org | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-3.0 | creativecommons org | creativecommons org licenses by nc nd 3 0
cc-by-nc-4.0 | creativecommons org | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | creativecommons org | creativecommons org licenses by nc 3 0
cc-by-nd-4.0 | creativecommons org | creativecommons org licenses by nd 4 0
cc-by-nd-3.0 | creativecommons org | creativecommons org licenses by nd 3 0
cc-by-sa-4.0 | creativecommons org | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org | creativecommons org licenses by sa 3 0
cc-by-sa-2.5 | creativecommons org | creativecommons org licenses by sa 2 5
cc-by-4.0 | creativecommons org | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org | creativecommons org licenses by 3 0
cc-by-2.5 | creativecommons org | creativecommons org licenses by 2 5
cc-by-2.0 | creativecommons org | creativecommons org licenses by 2 0
mit | opensource org | opensource org licenses? mit
apache-2.0 | apache org | (?:www )?apache org licenses license 2 0
gpl-3.0 | gnu org | (?:www )?gnu org licenses gpl 3 0
gpl-2.0 | gnu org | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
gpl | gnu org | (?:www )?gnu org licenses(?: gpl)?
lgpl | gnu org | (?:www )?gnu org licenses lgpl
agpl-3.0 | gnu org | (?:www )?gnu org licenses agpl
gfdl | gnu org | (?:www )?gnu org (?:licenses|copyleft) fdl
mpl-2.0 | mozilla org | (?:www )?mozilla org mpl 2 0
bsd | opensource org | opensource org licenses bsd
epl | eclipse org | (?:www )?eclipse org legal epl
"""

#: Names of licences with a version.
NAMES = r"""
gpl-3.0 | general public license | gnu general public license (?:version |v )3(?: 0)?
gpl-2.0 | general public license | gnu general public license (?:version |v )2(?: 0)?
gpl-1.0 | general public license | gnu general public license (?:version |v )1(?: 0)?
lgpl-3.0 | lesser general public | gnu lesser general public license (?:version |v )?3(?: 0)?
lgpl-2.1 | lesser general public | gnu lesser general public license (?:version |v )?2 1
lgpl | lesser general public | gnu lesser general public license
lgpl-2.0 | library general public | gnu library general public license
agpl-3.0 | affero general public | gnu affero general public license(?: (?:version |v )?3)?
gfdl-1.3 | free documentation | gnu free documentation license (?:version |v )?1 3
gfdl | free documentation | gnu free documentation license
gpl-3.0 | gplv3 | gplv3
gpl-2.0 | gplv2 | gplv2
lgpl-3.0 | lgplv3 | lgplv3
lgpl-2.1 | lgplv2 | lgplv2 1
agpl-3.0 | agplv3 | agplv3
apache-2.0 | apache licen | apache licen[sc]e (?:version |v )?2(?: 0)?
apache-1.1 | apache | apache (?:software )?licen[sc]e (?:version |v )?1 1
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd licen[sc]e
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd licen[sc]e
bsd-2-clause | bsd | (?:simplified|2 clause|two clause|freebsd) bsd licen[sc]e
bsd-2-clause | freebsd licen | freebsd licen[sc]e
bsd | bsd licen | bsd licen[sc]e
mit | expat licen | expat licen[sc]e
mit | mit licence | mit licence
x11 | x11 licen | x11 licen[sc]e
isc | isc licen | isc licen[sc]e
mpl-2.0 | mozilla public | mozilla public license (?:version |v )?2(?: 0)?
mpl-1.1 | mozilla public | mozilla public license (?:version |v )?1 1
mpl | mozilla public | mozilla public license
epl-2.0 | eclipse public | eclipse public license (?:version |v )?2(?: 0)?
epl-1.0 | eclipse public | eclipse public license (?:version |v )?1(?: 0)?
epl | eclipse public | eclipse public license
cpl-1.0 | common public license | common public license (?:version |v )?1 0
cddl-1.0 | common development and distribution | common development and distribution license
eupl | european union public | european union public licen[sc]e
bsl-1.0 | boost software | boost software license
zlib | zlib | zlib (?:libpng )?licen[sc]e
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1-4] \d)?
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1-4] \d)?
cc-by-nc | cc by nc | cc by nc(?: [1-4] \d)?
cc-by-nd | cc by nd | cc by nd(?: [1-4] \d)?
cc-by-sa | cc by sa | cc by sa(?: [1-4] \d)?
cc-by-4.0 | cc by | cc by 4 0
cc-by-3.0 | cc by | cc by 3 0
cc-by-2.0 | cc by | cc by 2 0
cc0-1.0 | cc0 | cc0(?: 1 0)?
artistic-2.0 | artistic license | artistic license 2 0
artistic-1.0 | artistic license | artistic license
ofl-1.1 | open font license | (?:sil )?open font license
odbl-1.0 | open database license | open database license
python-2.0 | python software foundation license | python software foundation license
php | php license | php license(?: (?:version |v )?3 0)?
ruby | ruby licen | ruby licen[sc]e
openssl | openssl license | openssl license
qpl-1.0 | q public license | q public license
afl | academic free license | academic free license
osl | open software license | open software license
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
ncsa | ncsa open source | (?:university of illinois )?ncsa open source license
upl-1.0 | universal permissive license | universal permissive license
sspl-1.0 | server side public license | server side public license
busl-1.1 | business source license | business source license(?: 1 1)?
elastic-2.0 | elastic license | elastic license(?: 2 0)?
mulan-psl-2.0 | mulan permissive | mulan permissive software license
openrail | openrail | (?:creativeml |bigscience )?openrail(?: m)?
"""

SECTIONS = ((TEXTS, 0.95), (NOTICES, 0.9), (TAGS, 0.85), (NAMES, 0.7))


def rules() -> list[tuple[str, float, str, str]]:
    """(label, strength, keyword, regular expression) of every rule, in order of priority."""
    found = []
    for text, strength in SECTIONS:
        for line in text.strip().splitlines():
            label, keyword, pattern = (x.strip() for x in line.split("|", 2))
            found.append((label, strength, keyword, pattern))
    return found
