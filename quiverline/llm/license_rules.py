"""Signature rules of the license scan, written by hand.

A line is `label | confidence | keywords | expression`.  Expressions match whole words of the normal form: lower case, one space
between words, punctuation gone.  A rule is tried only where one of its keywords (comma-separated; spaces count) stands in
the text; every match of the expression holds one.  Sections are in order of priority, and so are the rules of a section.
"""

#: Sentences of the licences themselves and of the notices that they ask for.
TEXTS = r"""
mit | 0.98 | hereby granted free | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?
mit | 0.95 | hereby granted free | permission is hereby granted free of charge to any person obtaining a copy
mit | 0.9 | above copyright notice and this permission | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions(?: of the software)?
mit | 0.85 | without restriction including | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
mit-0 | 0.9 | so subject to no | to permit persons to whom the software is furnished to do so subject to no conditions
x11 | 0.9 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11-distribute | 0.85 | name s of the above copyright holders | except as contained in this notice the name s of the above copyright holders shall not be used in advertising
isc | 0.95 | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | 0.96 | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?= the software is provided)
hpnd | 0.9 | without fee | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
ntp | 0.88 | with or without fee | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
bsd-3 | 0.96 | nor the names of | neither the names? of (?:[^ ]+ ){1,20}nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-3 | 0.9 | nor the names of | nor the names of (?:its|their|any) (?:contributors|co developers) may be used
bsd-4 | 0.95 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-1 | 0.6 | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd-2 | 0.75 | redistributions in binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-2 | 0.65 | binary forms with or without | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-freebsd | 0.9 | freebsd project | official policies either expressed or implied of the freebsd project
bsd-3-clear | 0.92 | no express or implied licenses | no express or implied licenses to any partys? (?:s )?patent rights are granted by this license
apache-2 | 0.95 | except in compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 0.85 | except in compliance | you may not use this (?:file|work|software) except in compliance with the license
apache-2 | 0.9 | contributor license agreements | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | 0.8 | on an as is basis | distributed on an as is basis without warranties or conditions of any kind
apache-2 | 0.9 | perpetual worldwide | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-1.1 | 0.92 | apache software foundation http | this product includes software developed by the apache software foundation http www apache org
apache-1 | 0.9 | apache group | this product includes software developed by the apache group
gpl-1-plus | 0.85 | either version 1 | either version 1(?: of the license)? or at your option any later version
gpl-2-plus | 0.9 | either version 2 | (?:gnu )?general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
gpl-3-plus | 0.9 | either version 3 | (?:gnu )?general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
gpl-2-plus | 0.8 | either version 2 | either version 2(?: of the license)? or at your option any later version
gpl-3-plus | 0.8 | either version 3 | either version 3(?: of the license)? or at your option any later version
lgpl-2.1-plus | 0.92 | either version 2 1 | either version 2 1(?: of the license)? or at your option any later version
gpl-2 | 0.9 | foundation version 2 | (?:gnu )?general public license(?: version 2)? as published by the free software foundation version 2
gpl | 0.75 | copy of the gnu general | you should have received a copy of the gnu general public license along with
lgpl | 0.8 | copy of the gnu lesser | you should have received a copy of the gnu lesser general public license along with
lgpl-2 | 0.8 | copy of the gnu library | you should have received a copy of the gnu library general public license along with
agpl | 0.85 | copy of the gnu affero | you should have received a copy of the gnu affero general public license along with
gpl-2 | 0.92 | version 2 june 1991 | gnu general public license version 2 june 1991
gpl-3 | 0.92 | version 3 29 june 2007 | gnu general public license version 3 29 june 2007
lgpl-2.1 | 0.92 | version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-2 | 0.92 | version 2 june 1991 | gnu library general public license version 2 june 1991
lgpl-3 | 0.92 | version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007
agpl-3 | 0.92 | version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
gpl | 0.6 | without even the implied | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl-exception-classpath | 0.9 | linking this library | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-exception-gcc | 0.9 | gcc runtime library exception | gcc runtime library exception(?: version 3 1)?
gpl-exception-bison | 0.85 | bison parser skeleton | under terms of your choice so long as that work isn t itself a parser generator using the skeleton|bison parser skeleton
mpl-1.1 | 0.92 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2 | 0.95 | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 0.85 | incompatible with secondary | this source code form is incompatible with secondary licenses
epl-1 | 0.92 | accompanying program is provided | the accompanying program is provided under the terms of this eclipse public license agreement
epl-2 | 0.92 | eclipse public license 2 0 | made available under the terms of the eclipse public license 2 0
epl-1 | 0.9 | eclipse public license v1 0 | made available under the terms of the eclipse public license v1 0
cddl-1 | 0.92 | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
cpl-1 | 0.9 | this common public license | provided under the terms of this common public license agreement
ipl-1 | 0.9 | ibm public license | provided under the terms of this ibm public license agreement
zlib | 0.96 | plainly marked as such | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 0.9 | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | 0.9 | png reference library | the png reference library is supplied as is
boost-1 | 0.95 | person or organization obtaining a copy | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost-1 | 0.95 | boost software license | distributed under the boost software license version 1 0
unlicense | 0.99 | free and unencumbered | this is free and unencumbered software released into the public domain
unlicense | 0.9 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | 0.97 | do what the fuck | do what the fuck you want to(?: public license)?
cc0 | 0.95 | waived all copyright | (?:has|have) waived all copyright and related or neighboring rights
cc0 | 0.9 | extent possible under law | to the extent possible under law
public-domain | 0.9 | author disclaims copyright | the author disclaims copyright to this source code
public-domain | 0.88 | into the public domain | (?:released|placed|dedicated|put) (?:[^ ]+ ){0,4}(?:in|into|to) the public domain
public-domain | 0.85 | public domain | (?:this|the) (?:[^ ]+ ){1,4}(?:is|are) in the public domain
beerware | 0.96 | buy me a beer | you think this stuff is worth it you can buy me a beer in return
json | 0.97 | for good not evil | the software shall be used for good not evil
openssl | 0.93 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 0.93 | eric young | this product includes cryptographic software written by eric young
curl | 0.85 | name of a copyright holder | except as contained in this notice the name of a copyright holder shall not be used in advertising
unicode | 0.9 | unicode data files | distribute the unicode data files and any associated documentation
w3c | 0.9 | w3c software | w3c software notice and license
python-2 | 0.9 | psf is making python | psf is making python available to licensee on an as is basis
python-2 | 0.9 | python software foundation license version 2 | python software foundation license version 2
ruby | 0.85 | freely modify this software | you may modify your copy of the software in any way
postgresql | 0.9 | without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ofl-1.1 | 0.95 | font software is licensed | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | 0.9 | reserved font name | no modified version of the font software may use the reserved font name s
artistic-2 | 0.9 | copyright holder intends that this package | copyright holder intends that this package be available
artistic-1 | 0.88 | semblance of artistic control | copyright holder maintains some semblance of artistic control
artistic-perl | 0.85 | same terms as perl | (?:redistribute|modify) (?:[^ ]+ ){0,6}under the same terms as perl(?: itself)?
ms-pl | 0.9 | microsoft public license ms pl | microsoft public license ms pl this license governs use of the accompanying software
ncsa | 0.9 | with the software without restriction | to deal with the software without restriction including without limitation
sleepycat | 0.9 | complete source code for the | information on how to obtain complete source code for the (?:db|software) software
zpl | 0.9 | zope | zope public license(?: zpl)? version 2 [01]
eupl-1.2 | 0.9 | european union public licence | this european union public licence the eupl applies to the work
sspl-1 | 0.92 | server side public license | offering the program as a service|server side public license version 1
bsl-1.1 | 0.92 | change date | on the change date or the fourth anniversary of the first publicly available distribution
elastic-2 | 0.9 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | 0.95 | commons clause | commons clause license condition(?: v1 0)?
polyform-noncommercial | 0.92 | polyform | polyform noncommercial license 1 0 0
hippocratic | 0.92 | hippocratic | hippocratic license(?: version)?(?: 2 1| 3 0)?
rail | 0.9 | use based restrictions | use based restrictions as referenced in paragraph
llama-community | 0.92 | community license | llama [234](?: [0-9])? (?:community|version) license(?: agreement)?
all-rights-reserved | 0.6 | all rights reserved | all rights reserved
proprietary | 0.85 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 0.85 | strictly prohibited | unauthorized (?:copying|reproduction|use|distribution) (?:[^ ]+ ){0,8}is strictly prohibited
proprietary | 0.8 | without the prior written | may not be (?:reproduced|copied|distributed) (?:[^ ]+ ){0,12}without the prior written (?:permission|consent)
non-commercial | 0.8 | commercial | for (?:personal|academic|research|educational)(?: and [a-z]+)? (?:use|purposes) only(?: no commercial use)?
non-commercial | 0.8 | commercial use | (?:not for commercial use|no commercial use|non ?commercial use only)
"""

#: Machine-readable identifiers and the licences' own addresses.
IDENTIFIERS = r"""
mit | 1.0 | spdx | spdx license identifier mit
mit-0 | 1.0 | spdx | spdx license identifier mit 0
apache-2 | 1.0 | spdx | spdx license identifier apache 2 0
apache-1.1 | 1.0 | spdx | spdx license identifier apache 1 1
bsd-2 | 1.0 | spdx | spdx license identifier bsd 2 clause
bsd-3 | 1.0 | spdx | spdx license identifier bsd 3 clause
bsd-4 | 1.0 | spdx | spdx license identifier bsd 4 clause
0bsd | 1.0 | spdx | spdx license identifier 0bsd
isc | 1.0 | spdx | spdx license identifier isc
gpl-2 | 1.0 | spdx | spdx license identifier gpl 2 0(?: only)?(?! or| plus)
gpl-2-plus | 1.0 | spdx | spdx license identifier gpl 2 0(?: or later|\+)
gpl-3 | 1.0 | spdx | spdx license identifier gpl 3 0(?: only)?(?! or)
gpl-3-plus | 1.0 | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.1 | 1.0 | spdx | spdx license identifier lgpl 2 1(?: only)?(?! or)
lgpl-2.1-plus | 1.0 | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3 | 1.0 | spdx | spdx license identifier lgpl 3 0(?: only)?(?! or)
lgpl-3-plus | 1.0 | spdx | spdx license identifier lgpl 3 0 or later
agpl-3 | 1.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
mpl-2 | 1.0 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | 1.0 | spdx | spdx license identifier mpl 1 1
epl-1 | 1.0 | spdx | spdx license identifier epl 1 0
epl-2 | 1.0 | spdx | spdx license identifier epl 2 0
cddl-1 | 1.0 | spdx | spdx license identifier cddl 1 [01]
boost-1 | 1.0 | spdx | spdx license identifier bsl 1 0
bsl-1.1 | 1.0 | spdx | spdx license identifier busl 1 1
zlib | 1.0 | spdx | spdx license identifier zlib
unlicense | 1.0 | spdx | spdx license identifier unlicense
cc0 | 1.0 | spdx | spdx license identifier cc0 1 0
cc-by-4 | 1.0 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4 | 1.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4 | 1.0 | spdx | spdx license identifier cc by nc 4 0
ofl-1.1 | 1.0 | spdx | spdx license identifier ofl 1 1
artistic-2 | 1.0 | spdx | spdx license identifier artistic 2 0
eupl-1.2 | 1.0 | spdx | spdx license identifier eupl 1 2
sspl-1 | 1.0 | spdx | spdx license identifier sspl 1 0
python-2 | 1.0 | spdx | spdx license identifier (?:psf|python) 2 0
wtfpl | 1.0 | spdx | spdx license identifier wtfpl
postgresql | 1.0 | spdx | spdx license identifier postgresql
ncsa | 1.0 | spdx | spdx license identifier ncsa
mit | 0.95 | opensource org | opensource org licenses mit(?: license(?: php| html)?)?
bsd-2 | 0.95 | opensource org | opensource org licenses bsd 2 clause
bsd-3 | 0.95 | opensource org | opensource org licenses bsd 3 clause
isc | 0.95 | opensource org | opensource org licenses isc(?: license(?: txt)?)?
apache-2 | 0.95 | apache org licenses | apache org licenses license 2 0(?: txt| html)?
gpl-2 | 0.9 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3 | 0.9 | gnu org licenses | gnu org licenses gpl 3 0(?: html| txt)?
gpl | 0.8 | gnu org licenses | gnu org licenses gpl(?: html| txt)?
lgpl-2.1 | 0.9 | gnu org licenses | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl | 0.8 | gnu org licenses | gnu org licenses lgpl(?: html| txt)?
agpl-3 | 0.9 | gnu org licenses | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
mpl-2 | 0.95 | mozilla org | mozilla org mpl 2 0
mpl-1.1 | 0.9 | mozilla org | mozilla org mpl mpl 1 1(?: html)?
epl-1 | 0.9 | eclipse org legal | eclipse org legal epl v10(?: html)?
epl-2 | 0.9 | eclipse org legal | eclipse org legal epl 2 0(?: html)?
boost-1 | 0.95 | boost org license | boost org license 1 0(?: txt)?
unlicense | 0.95 | unlicense org | (?:http |https )?unlicense org
wtfpl | 0.95 | wtfpl net | (?:www )?wtfpl net
cc0 | 0.95 | creativecommons org | creativecommons org publicdomain zero 1 0
public-domain | 0.85 | creativecommons org | creativecommons org publicdomain mark 1 0
cc-by-nc-sa | 0.95 | creativecommons org | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 0.95 | creativecommons org | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc | 0.95 | creativecommons org | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-sa | 0.95 | creativecommons org | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd | 0.95 | creativecommons org | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by | 0.95 | creativecommons org | creativecommons org licenses by(?: [1-4] [05])?
ofl-1.1 | 0.9 | scripts sil org | scripts sil org ofl
odbl | 0.9 | opendatacommons org | opendatacommons org licenses odbl(?: 1 0)?
odc-by | 0.9 | opendatacommons org | opendatacommons org licenses by(?: 1 0)?
pddl | 0.9 | opendatacommons org | opendatacommons org licenses pddl(?: 1 0)?
"""

#: Grants and names that say which version they mean.
NAMES = r"""
mit | 0.95 | mit | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat)(?: x11)? licen[cs]e
mit | 0.9 | mit | (?:licensed|released|distributed|available|published|provided) under (?:the )?mit
mit | 0.9 | mit | (?:under|subject to|governed by|covered by) the (?:terms of the )?(?:mit|expat) licen[cs]e
mit | 0.8 | mit,expat | (?:the )?(?:mit|expat) (?:software |x11 )?licen[cs]e
mit | 0.7 | mit | licen[cs]e mit
mit | 0.7 | mit licensed | (?:is )?mit licensed
x11 | 0.8 | x11 | (?:the )?x11 licen[cs]e
apache-2 | 0.95 | apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?(?: licen[cs]e)?
apache-2 | 0.9 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2 | 0.85 | apache | apache(?: v)? ?2(?: 0)? licen[cs]e
apache-2 | 0.8 | alv2,asl 2 | (?:alv2|asl 2 0)
apache-2 | 0.7 | apache 2 | licen[cs]e apache 2(?: 0)?
apache-1.1 | 0.9 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?1 1
apache-1 | 0.9 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?1 0
bsd-0 | 0.9 | zero clause,0 clause | (?:the )?(?:bsd )?(?:zero|0) clause(?: bsd)?(?: licen[cs]e)?
bsd-2 | 0.92 | 2 clause,two clause | (?:the )?(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: simplified)?(?: licen[cs]e)?
bsd-2 | 0.9 | simplified bsd | (?:the )?simplified bsd(?: licen[cs]e)?
bsd-2-freebsd | 0.9 | freebsd | (?:the )?freebsd licen[cs]e
bsd-3 | 0.92 | 3 clause,three clause | (?:the )?(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: new| revised)?(?: licen[cs]e)?
bsd-3 | 0.9 | new bsd,modified bsd,revised bsd | (?:the )?(?:new|modified|revised) bsd(?: licen[cs]e)?
bsd-3-clear | 0.92 | clear bsd | (?:the )?clear bsd licen[cs]e
bsd-4 | 0.92 | 4 clause,four clause | (?:the )?(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)?
bsd-4 | 0.9 | original bsd | (?:the )?original bsd(?: licen[cs]e)?
lgpl-2 | 0.92 | library general,lgpl | (?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version| v)? ?2(?: 0)?(?! 1)
lgpl-2.1-plus | 0.94 | or later,any later | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?2 1 or (?:any )?later(?: version)?
lgpl-2.1 | 0.92 | lesser general,lgpl | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?2 1(?: only)?
lgpl-3 | 0.92 | lesser general,lgpl | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?3(?: 0)?(?: or later)?
lgpl-3 | 0.85 | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | 0.85 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
agpl-1 | 0.92 | affero | affero general public licen[cs]e(?: version| v)? ?1(?: 0)?
agpl-3 | 0.92 | affero,agpl | (?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v)? ?3(?: 0)?(?: or later)?
agpl-3 | 0.85 | agplv3 | (?:gnu )?agplv3
gpl-1 | 0.9 | general public,gpl | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?1(?: 0)?
gpl-2-plus | 0.93 | or later,any later | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?2(?: 0)? or (?:any )?later(?: version)?
gpl-3-plus | 0.93 | or later,any later | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?3(?: 0)? or (?:any )?later(?: version)?
gpl-2 | 0.9 | general public,gpl | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?2(?: 0)?(?: only)?
gpl-3 | 0.9 | general public,gpl | (?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?3(?: 0)?(?: only)?
gpl-2 | 0.85 | gplv2 | (?:gnu )?gplv2(?: 0)?
gpl-3 | 0.85 | gplv3 | (?:gnu )?gplv3(?: 0)?
gfdl | 0.9 | free documentation,gfdl | (?:gnu )?free documentation licen[cs]e(?: version| v)?(?: 1 [123])?
mpl-1 | 0.9 | mozilla public,mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? ?1(?: 0)?
mpl-1.1 | 0.92 | mozilla public,mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? ?1 1
mpl-2 | 0.92 | mozilla public,mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? ?2(?: 0)?
npl | 0.9 | netscape | netscape public licen[cs]e(?: version| v)?(?: 1 [01])?
epl-1 | 0.92 | eclipse public,epl | (?:eclipse public licen[cs]e|epl)(?: version| v)? ?1(?: 0)?
epl-2 | 0.92 | eclipse public,epl | (?:eclipse public licen[cs]e|epl)(?: version| v)? ?2(?: 0)?
edl-1 | 0.9 | eclipse distribution | eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)?
eupl-1.1 | 0.9 | european union,eupl | (?:european union public licen[cs]e|eupl)(?: version| v)? ?1 1
eupl-1.2 | 0.9 | european union,eupl | (?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2
cddl-1.1 | 0.9 | common development,cddl | (?:common development and distribution licen[cs]e|cddl)(?: cddl)?(?: version| v)? ?1 1
cddl-1 | 0.9 | common development,cddl | (?:common development and distribution licen[cs]e|cddl)(?: cddl)?(?: version| v)? ?1(?: 0)?
cpl-1 | 0.9 | common public | common public licen[cs]e(?: version| v)? ?1(?: 0)?
cpal-1 | 0.9 | common public attribution | common public attribution licen[cs]e(?: version| v)?(?: 1 0)?
ipl-1 | 0.88 | ibm public | ibm public licen[cs]e(?: version| v)?(?: 1 0)?
lppl | 0.9 | latex project | latex project public licen[cs]e(?: version| v)?(?: 1 [0-3](?: [abc])?)?
isc | 0.9 | isc | (?:licensed|released|distributed|available) under (?:the )?isc(?: licen[cs]e)?
isc | 0.8 | isc licen | (?:the )?isc licen[cs]e
zlib | 0.8 | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | 0.8 | libpng | (?:the )?libpng licen[cs]e(?: version 2)?
boost-1 | 0.9 | boost software | boost software licen[cs]e(?: version| v)? ?1(?: 0)?
artistic-1 | 0.9 | artistic | (?:perl )?artistic licen[cs]e(?: version| v)? ?1(?: 0)?
artistic-2 | 0.9 | artistic | artistic licen[cs]e(?: version| v)? ?2(?: 0)?
unlicense | 0.85 | unlicense | (?:under )?the unlicense
wtfpl | 0.9 | wtfpl | (?:the )?wtfpl(?: version 2| v2)?
beerware | 0.85 | beerware,beer ware | (?:the )?beer ?ware licen[cs]e
cc0 | 0.92 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication| licen[cs]e)?
cc0 | 0.9 | zero | creative commons zero(?: v1 0| 1 0)?(?: universal)?
cc-by-nc-sa | 0.92 | by nc sa | cc by nc sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-nd | 0.92 | by nc nd | cc by nc nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc | 0.9 | cc by nc | cc by nc(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-sa | 0.92 | cc by sa | cc by sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nd | 0.92 | cc by nd | cc by nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by | 0.85 | cc by | cc by(?! (?:nc|nd|sa))(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-sa | 0.92 | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd | 0.92 | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc | 0.9 | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa | 0.92 | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd | 0.92 | creative commons | creative commons attribution no ?deriv(?:s|atives|ative works)?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by | 0.85 | creative commons | creative commons attribution(?! (?:non|no|share))(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-sampling | 0.9 | sampling plus | (?:creative commons )?sampling plus(?: 1 0)?
odbl | 0.9 | open database,odbl | (?:open database licen[cs]e|odbl)(?: version| v)?(?: 1 0)?
odc-by | 0.9 | open data commons | open data commons attribution(?: licen[cs]e)?(?: v1 0)?
pddl | 0.9 | public domain dedication and | public domain dedication and licen[cs]e(?: version| v)?(?: 1 0)?
python-2 | 0.85 | python software foundation,psf | (?:python software foundation|psf) licen[cs]e(?: version 2| v2)?
postgresql | 0.85 | postgresql | (?:the )?postgresql licen[cs]e
ms-pl | 0.9 | microsoft public,ms pl | (?:microsoft public licen[cs]e|ms pl)
ms-rl | 0.9 | microsoft reciprocal,ms rl | (?:microsoft reciprocal licen[cs]e|ms rl)
ofl-1.1 | 0.9 | open font,ofl | (?:sil )?(?:open font licen[cs]e|ofl)(?: version| v)?(?: 1 1)?
afl-3 | 0.9 | academic free | academic free licen[cs]e(?: version| v)? ?3(?: 0)?
afl-2.1 | 0.9 | academic free | academic free licen[cs]e(?: version| v)? ?2(?: [01])?
osl-3 | 0.9 | open software licen | open software licen[cs]e(?: version| v)? ?3(?: 0)?
osl-2.1 | 0.9 | open software licen | open software licen[cs]e(?: version| v)? ?2(?: [01])?
ncsa | 0.9 | illinois,ncsa | (?:university of illinois|ncsa)(?: ncsa)? open source licen[cs]e
php-3 | 0.9 | php | php licen[cs]e(?: version| v)? ?3(?: 01| 0)?
ruby | 0.8 | ruby licen | (?:the )?ruby licen[cs]e
vim | 0.8 | vim licen | (?:the )?vim licen[cs]e
upl-1 | 0.9 | universal permissive | universal permissive licen[cs]e(?: version| v)?(?: 1 0)?
bsl-1.1 | 0.9 | business source | business source licen[cs]e(?: version| v)?(?: 1 1)?
sspl-1 | 0.9 | server side public,sspl | (?:server side public licen[cs]e|sspl)(?: version| v)?(?: ?1)?
elastic-2 | 0.9 | elastic licen | elastic licen[cs]e(?: version| v)?(?: ?2(?: 0)?)?
confluent | 0.9 | confluent community | confluent community licen[cs]e(?: version| v)?(?: 1 0)?
ecl-2 | 0.9 | educational community | educational community licen[cs]e(?: version| v)?(?: 2 0)?
cecill | 0.9 | cecill | cecill(?: [bc])?(?: licen[cs]e)?(?: version| v)?(?: [12](?: [01])?)?
mulan-psl | 0.9 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: v| version)? ?[12]
qpl | 0.9 | q public | q public licen[cs]e(?: version| v)?(?: 1 0)?
sleepycat | 0.85 | sleepycat | (?:the )?sleepycat licen[cs]e
unicode | 0.85 | unicode licen | unicode licen[cs]e(?: agreement| v3)?
w3c | 0.85 | w3c | w3c (?:software|document) (?:and document )?licen[cs]e
zpl | 0.85 | zope public | zope public licen[cs]e
json | 0.8 | json licen | (?:the )?json licen[cs]e
openssl | 0.85 | openssl licen | (?:the )?openssl licen[cs]e
curl | 0.8 | curl licen | (?:the )?curl licen[cs]e
nasa | 0.9 | nasa open source | nasa open source agreement(?: version| v)?(?: 1 3)?
apsl | 0.9 | apple public source | apple public source licen[cs]e(?: version| v)?(?: [12] [0-2])?
rpl | 0.9 | reciprocal public | reciprocal public licen[cs]e(?: version| v)?(?: 1 [15])?
sun-sissl | 0.9 | sun industry | sun industry standards source licen[cs]e
bittorrent | 0.85 | bittorrent open source | bittorrent open source licen[cs]e
openrail | 0.9 | openrail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m| d)?(?: licen[cs]e)?
ogl-uk | 0.9 | open government | open government licen[cs]e(?: version| v)?(?: [123] 0)?
etalab | 0.85 | etalab,licence ouverte | (?:etalab|licence ouverte)(?: open licen[cs]e)?(?: 2 0)?
proprietary | 0.85 | proprietary | (?:under|subject to) (?:a|the) proprietary licen[cs]e
proprietary | 0.7 | proprietary | proprietary (?:software )?licen[cs]e
commercial | 0.75 | commercial licen | (?:a |the )?commercial licen[cs]e
"""

#: Names that leave the version open; lesser, library and affero licences hold the general one's name.
OPEN_NAMES = r"""
apache | 0.5 | apache | (?:licensed|released|distributed|available) under (?:the )?apache(?: software)?(?: licen[cs]e)?
apache | 0.4 | apache | apache(?: software)? licen[cs]e
bsd | 0.5 | bsd | (?:licensed|released|distributed|available) under (?:the |a )?bsd(?: style)?(?: licen[cs]e)?
bsd | 0.4 | bsd | bsd(?: style)? licen[cs]e
agpl | 0.5 | affero,agpl | (?:gnu )?(?:affero general public licen[cs]e|agpl)
lgpl | 0.5 | lesser general,library general,lgpl | (?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)
gpl | 0.5 | general public | (?<!lesser )(?<!library )(?<!affero )(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e
gpl | 0.45 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl
gpl | 0.4 | gpl | (?:gnu )?gpl(?: licen[cs]e)?
mpl | 0.45 | mozilla public | mozilla public licen[cs]e
epl | 0.45 | eclipse public | eclipse public licen[cs]e
eupl | 0.45 | european union public | european union public licen[cs]e
cddl | 0.45 | common development | common development and distribution licen[cs]e
cpl | 0.45 | common public | common public licen[cs]e
boost | 0.45 | boost | boost(?: software)? licen[cs]e
artistic | 0.45 | artistic | (?:perl )?artistic licen[cs]e
afl | 0.45 | academic free | academic free licen[cs]e
osl | 0.45 | open software licen | open software licen[cs]e
php | 0.45 | php licen | php licen[cs]e
creative-commons | 0.4 | creative commons | creative commons licen[cs]e
public-domain | 0.4 | public domain | public domain
open-source | 0.3 | open source licen | open source licen[cs]e
"""

SECTIONS = (IDENTIFIERS, TEXTS, NAMES, OPEN_NAMES)


def parsed() -> list[tuple[str, float, list[str], str]]:
    """(label, confidence, keywords, expression) of all rules, in order of priority."""
    out = []
    for section in SECTIONS:
        for line in section.strip().splitlines():
            label, confidence, keywords, expression = line.split(" | ", 3)
            out.append((label.strip(), float(confidence), keywords.split(","), expression))
    return out
