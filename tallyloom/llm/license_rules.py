"""Signature rules of licence texts, notices, tags and names, in order of priority.

A line is `label: gate: pattern`. Patterns are matched against a text's words, lower-cased and set apart by single blanks,
and begin and end with whole words. The gate names words that every match holds: all of those set apart by `+`, any of
those by `/`; a rule is tried only on texts that have them. {under}, {the} and {v} stand for the phrases in MACROS.
"""

from __future__ import annotations

#: Levels, highest first, and how sure a detection of each is: sentences of the licence itself, grants under a named
#: licence, machine-readable tags, names alone, and wording that hints at a licence without naming one.
LEVELS = {"text": 1.0, "notice": 0.9, "tag": 0.85, "name": 0.7, "hint": 0.4}

MACROS = {
    "under": "(?:licensed|released|distributed|available|provided|published|offered|covered|governed|redistributed|used) (?:under|by)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)?",
    "the": "(?:the )?",
    "v": "(?:version |v |ver )?",
}

#: The phrases whose places are counted as base.
BASE = "mit apache-2 cc-by-nc"

TABLE = r"""
[text]
mit: hereby+charge+software: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit: without+restriction+sublicense: without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit: substantial+portions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0: restriction+furnished: to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11: advertising+consortium: except as contained in this notice the name of the x consortium shall not be used in advertising
isc: purpose+fee+hereby: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
isc: purpose+fee+hereby: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
0bsd: purpose+fee+hereby: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
bsd: redistribution+permitted: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions+retain: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: redistributions+reproduce: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause: endorse+promote: neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of (?:its|their) contributors may be used to endorse or promote products
bsd-3-clause: endorse+promote: the name of the (?:author|copyright holder)s? may not be used to endorse or promote products derived from this software
bsd-4-clause: advertising+acknowledgement: all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd: contributors+implied: this software is provided by the copyright holders and contributors as is and any express or implied warranties
apache-2: perpetual+royalty+irrevocable: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? (?:copyright|patent) license
apache-2: prominent+notices: you must cause any modified files to carry prominent notices stating that you changed the files
apache-2: compliance+obtain+except: you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-1.1: foundation+apache: this product includes software developed by the apache software foundation
gpl: freedom+share: the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl: copyleft+software: the gnu general public license is a free copyleft license for software and other kinds of works
gpl: warranty+merchantability+gnu: without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl: warranty+merchantability+lesser: without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license
agpl: warranty+merchantability+affero: without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license
agpl-3: remotely+interacting: all users interacting with it remotely through a computer network
lgpl: incorporates+lesser: the gnu lesser general public license incorporates the terms and conditions of version 3
gfdl: textbook+manual: the purpose of this license is to make a manual textbook or other functional and useful document free
mpl-2: subject+mozilla+source: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1: contents+mozilla+subject: the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0: contents+mozilla+subject: the contents of this file are subject to the mozilla public license version 1 0
epl-1: accompanying+eclipse: the accompanying program is provided under the terms of this eclipse public license
cddl-1: contents+development+distribution: the contents of this file are subject to the terms of the common development and distribution license
unlicense: unencumbered+domain: this is free and unencumbered software released into the public domain
unlicense: anyone+compiled+binary: anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
cc0-1.0: waives+affirmer: affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1.0: dedicated+waiving: has dedicated the work to the public domain by waiving all of his or her rights
wtfpl: verbatim+changing: everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
zlib: express+arising+liable: this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use
zlib: misrepresented+origin: the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0: entire+grant: the copyright notices in the software and this entire statement including the above license grant
artistic-1.0: intent+package: the intent of this document is to state the conditions under which a package may be copied
artistic-2.0: package+redistributed: this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
postgresql: agreement+fee+hereby: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa: illinois+contributors: university of illinois (?:at )?urbana champaign nor the names of its contributors
openssl: openssl+toolkit: this product includes software developed by the openssl project for use in the openssl toolkit
json: shall+evil: the software shall be used for good not evil
beerware: beer+meet+worth: if we meet some day and you think this stuff is worth it you can buy me a beer
cc-by: redistribute+medium: you are free to share copy and redistribute the material in any medium or format
ofl-1.1: font+sold+itself: neither the font software nor any of its individual components in original or modified versions may be sold by itself
python-2.0: psf+licensee: psf hereby grants licensee a nonexclusive royalty free world wide license
ruby: verbatim+restriction: you may make and give away verbatim copies of the source form of the software without restriction
odbl-1.0: database+contents: any rights in individual contents of the database are licensed under the database contents license
ogl-uk-3.0: sector+government: contains public sector information licensed under the open government licence
[notice]
mit: mit+license+under: under the mit license
apache-2: apache+license+version: apache license version 2
cc-by-nc: cc+by+nc: cc by nc
mit: mit+license/licence: {under} mit(?: style| x11| expat)?(?: open source)?(?: licen[sc]e)
mit: mit+subject: subject to the (?:terms of the )?mit licen[sc]e
mit: mit+license: see (?:the )?(?:file )?license(?: file)? for (?:the )?mit(?: license)?(?: terms)?
mit: expat: {under} expat licen[sc]e
x11: x11: {under} x11 licen[sc]e
isc: isc: {under} isc licen[sc]e
apache-2: apache: {under} apache(?: software)?(?: foundation)? licen[sc]e {v}2(?: 0)?
apache-2: apache: {under} apache {v}2(?: 0)?(?: licen[sc]e)?
apache-1.1: apache: {under} apache(?: software)? licen[sc]e {v}1 1
apache: apache: {under} apache(?: software)? licen[sc]e
gpl-3-or-later: gnu+later: gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? {v}3(?: 0)?(?: of the licen[sc]e)? or(?: at your option)? any later version
gpl-2-or-later: gnu+later: gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? {v}2(?: 0)?(?: of the licen[sc]e)? or(?: at your option)? any later version
gpl-3: gnu: {under} gnu general public licen[sc]e {v}3(?: 0)?
gpl-2: gnu: {under} gnu general public licen[sc]e {v}2(?: 0)?
gpl-1: gnu: {under} gnu general public licen[sc]e {v}1(?: 0)?
gpl: gnu: {under} gnu general public licen[sc]e
gpl-3: gpl: {under} gnu gpl {v}3(?: 0)?
gpl-2: gpl: {under} gnu gpl {v}2(?: 0)?
gpl-3: gpl: {under} gpl {v}3(?: 0)?
gpl-2: gpl: {under} gpl {v}2(?: 0)?
gpl-3: gplv3: {under} (?:gnu )?gplv3
gpl-2: gplv2: {under} (?:gnu )?gplv2
gpl: gpl: {under} (?:gnu )?gpl
lgpl-3-or-later: lesser+later: gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? {v}3(?: 0)?(?: of the licen[sc]e)? or(?: at your option)? any later version
lgpl-2.1-or-later: lesser+later: gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? {v}2 1(?: of the licen[sc]e)? or(?: at your option)? any later version
lgpl-3: lesser: {under} gnu lesser general public licen[sc]e {v}3(?: 0)?
lgpl-2.1: lesser: {under} gnu lesser general public licen[sc]e {v}2 1
lgpl-2: library: {under} gnu library general public licen[sc]e {v}2(?: 0)?
lgpl: lesser: {under} gnu lesser general public licen[sc]e
lgpl: lgpl/lgplv2/lgplv3: {under} (?:gnu )?lgpl(?:v[23])?
agpl-3-or-later: affero+later: gnu affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)? {v}3(?: 0)?(?: of the licen[sc]e)? or(?: at your option)? any later version
agpl-3: affero: {under} gnu affero general public licen[sc]e {v}3(?: 0)?
agpl: affero: {under} (?:gnu )?affero general public licen[sc]e
agpl: agpl/agplv3: {under} (?:gnu )?agpl(?:v3)?
gfdl-1.3: documentation+gnu: {under} gnu free documentation licen[sc]e {v}1 3
gfdl-1.2: documentation+gnu: {under} gnu free documentation licen[sc]e {v}1 2
gfdl: documentation+gnu: {under} gnu free documentation licen[sc]e
mpl-2: mozilla: {under} mozilla public licen[sc]e {v}2(?: 0)?
mpl-1.1: mozilla: {under} mozilla public licen[sc]e {v}1 1
mpl: mozilla: {under} mozilla public licen[sc]e
mpl-2: mpl: {under} mpl {v}2(?: 0)?
epl-2: eclipse: {under} eclipse public licen[sc]e {v}2(?: 0)?
epl-1: eclipse: {under} eclipse public licen[sc]e {v}1(?: 0)?
epl: eclipse: {under} eclipse public licen[sc]e
edl-1: eclipse: {under} eclipse distribution licen[sc]e {v}1(?: 0)?
cpl-1: common: {under} common public licen[sc]e {v}1(?: 0)?
cddl-1.1: cddl: {under} cddl {v}1 1
cddl-1: cddl: {under} cddl(?: {v}1 0)?
cddl-1: development+distribution: {under} common development and distribution licen[sc]e
bsd-2-clause: bsd: {under} (?:simplified|freebsd|2 clause|two clause) bsd(?: style)? licen[sc]e
bsd-3-clause: bsd: {under} (?:new|modified|revised|3 clause|three clause) bsd(?: style)? licen[sc]e
bsd-4-clause: bsd: {under} (?:original|old|4 clause|four clause) bsd(?: style)? licen[sc]e
bsd-2-clause: bsd: {under} bsd (?:2|two) clause(?: simplified)?(?: licen[sc]e)?
bsd-3-clause: bsd: {under} bsd (?:3|three) clause(?: new| revised)?(?: licen[sc]e)?
0bsd: bsd/0bsd: {under} (?:0bsd|(?:0|zero) (?:clause )?bsd)(?: licen[sc]e)?
bsd: bsd: {under} bsd(?: style| type)?(?: licen[sc]e)
zlib: zlib: {under} zlib(?: libpng)? licen[sc]e
bsl-1.0: boost: {under} boost software licen[sc]e(?: {v}1 0)?
unlicense: unlicense: {under} unlicense
wtfpl: wtfpl: {under} wtfpl
artistic-2.0: artistic: {under} artistic licen[sc]e {v}2(?: 0)?
artistic-1.0: artistic: {under} artistic licen[sc]e {v}1(?: 0)?
artistic: artistic: {under} artistic licen[sc]e
perl: perl+same: (?:under|on) the same terms as perl(?: itself)?
python-2.0: python: {under} python(?: software foundation)? licen[sc]e(?: {v}2)?
php-3.01: php: {under} php licen[sc]e(?: {v}3(?: 0| 01)?)?
postgresql: postgresql: {under} postgresql licen[sc]e
openssl: openssl: {under} openssl licen[sc]e
ms-pl: microsoft: {under} microsoft public licen[sc]e
ms-rl: microsoft: {under} microsoft reciprocal licen[sc]e
eupl-1.2: eupl/european: {under} (?:eupl|european union public licen[sc]e) {v}1 2
eupl-1.1: eupl/european: {under} (?:eupl|european union public licen[sc]e) {v}1 1
eupl: eupl/european: {under} (?:eupl|european union public licen[sc]e)
cecill-2.1: cecill: {under} cecill(?: b| c)?(?: licen[sc]e)?(?: {v}2(?: [01])?)?
osl-3.0: open: {under} open software licen[sc]e {v}3(?: 0)?
afl-3.0: academic: {under} academic free licen[sc]e {v}3(?: 0)?
ecl-2.0: educational: {under} educational community licen[sc]e(?: {v}2(?: 0)?)?
upl-1.0: universal: {under} universal permissive licen[sc]e(?: {v}1(?: 0)?)?
ncsa: ncsa: {under} (?:university of illinois )?ncsa(?: open source)? licen[sc]e
ofl-1.1: sil/ofl/font: {under} (?:sil )?(?:open font licen[sc]e|ofl)(?: {v}1 1)?
cc0-1.0: cc0: {under} (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-4.0: cc+by: {under} cc by 4 0
cc-by-3.0: cc+by: {under} cc by 3 0
cc-by: cc+by: {under} cc by
cc-by-sa-4.0: cc+by+sa: {under} cc by sa 4 0
cc-by-sa-3.0: cc+by+sa: {under} cc by sa 3 0
cc-by-sa: cc+by+sa: {under} cc by sa
cc-by-nd-4.0: cc+by+nd: {under} cc by nd 4 0
cc-by-nd: cc+by+nd: {under} cc by nd
cc-by-nc-4.0: cc+by+nc: {under} cc by nc 4 0
cc-by-nc-3.0: cc+by+nc: {under} cc by nc 3 0
cc-by-nc: cc+by+nc: {under} cc by nc
cc-by-nc-sa-4.0: cc+by+nc+sa: {under} cc by nc sa 4 0
cc-by-nc-sa-3.0: cc+by+nc+sa: {under} cc by nc sa 3 0
cc-by-nc-sa: cc+by+nc+sa: {under} cc by nc sa
cc-by-nc-nd-4.0: cc+by+nc+nd: {under} cc by nc nd 4 0
cc-by-nc-nd-3.0: cc+by+nc+nd: {under} cc by nc nd 3 0
cc-by-nc-nd: cc+by+nc+nd: {under} cc by nc nd
cc-by-nc-nd: creative+noderivatives/derivatives: {under} creative commons attribution non ?commercial no ?derivatives(?: [0-9] [0-9])?
cc-by-nc-nd: creative+noderivs: {under} creative commons attribution non ?commercial noderivs(?: [0-9] [0-9])?
cc-by-nc-sa: creative+share/sharealike: {under} creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?
cc-by-nc: creative+commercial/noncommercial: {under} creative commons attribution non ?commercial(?: [0-9] [0-9])?
cc-by-sa: creative+share/sharealike: {under} creative commons attribution share ?alike(?: [0-9] [0-9])?
cc-by-nd: creative+noderivatives/derivatives: {under} creative commons attribution no ?derivatives(?: [0-9] [0-9])?
cc-by: creative+attribution: {under} creative commons attribution(?: [0-9] [0-9])?
cc: creative+commons: {under} creative commons(?: licen[sc]e)
odbl-1.0: odbl/database: {under} (?:odbl|open database licen[sc]e)(?: {v}1 0)?
odc-by-1.0: data+commons: {under} open data commons attribution licen[sc]e
pddl-1.0: domain+dedication: {under} (?:open data commons )?public domain dedication and licen[sc]e
ogl-uk-3.0: open+government: {under} open government licen[sc]e(?: {v}3(?: 0)?)?
busl-1.1: business: {under} business source licen[sc]e(?: {v}1 1)?
elastic-2.0: elastic: {under} elastic licen[sc]e(?: {v}2(?: 0)?)?
sspl-1.0: server: {under} server side public licen[sc]e(?: {v}1)?
public-domain: domain+public: (?:released|placed|dedicated) (?:in|into|to) the public domain
commercial: commercial+license/licence: {under} (?:a )?commercial licen[sc]e
proprietary: proprietary+confidential: (?:confidential and proprietary|proprietary and confidential)(?: information)?
[tag]
mit: spdx: spdx license identifier mit
mit-0: spdx: spdx license identifier mit 0
isc: spdx: spdx license identifier isc
0bsd: spdx: spdx license identifier 0bsd
apache-2: spdx+apache: spdx license identifier apache 2 0
apache-2-llvm: spdx+apache+llvm: spdx license identifier apache 2 0 with llvm exception
bsd-2-clause: spdx+bsd: spdx license identifier bsd 2 clause
bsd-3-clause: spdx+bsd: spdx license identifier bsd 3 clause
bsd-4-clause: spdx+bsd: spdx license identifier bsd 4 clause
gpl-2: spdx+gpl: spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later: spdx+gpl+later: spdx license identifier gpl 2 0 or later
gpl-3: spdx+gpl: spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later: spdx+gpl+later: spdx license identifier gpl 3 0 or later
gpl-2-classpath: spdx+gpl+classpath: spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
lgpl-2.1: spdx+lgpl: spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later: spdx+lgpl+later: spdx license identifier lgpl 2 1 or later
lgpl-3: spdx+lgpl: spdx license identifier lgpl 3 0(?: only)?
lgpl-3-or-later: spdx+lgpl+later: spdx license identifier lgpl 3 0 or later
agpl-3: spdx+agpl: spdx license identifier agpl 3 0(?: only)?
agpl-3-or-later: spdx+agpl+later: spdx license identifier agpl 3 0 or later
mpl-2: spdx+mpl: spdx license identifier mpl 2 0
mpl-1.1: spdx+mpl: spdx license identifier mpl 1 1
epl-2: spdx+epl: spdx license identifier epl 2 0
epl-1: spdx+epl: spdx license identifier epl 1 0
cddl-1: spdx+cddl: spdx license identifier cddl 1 0
bsl-1.0: spdx+bsl: spdx license identifier bsl 1 0
busl-1.1: spdx+busl: spdx license identifier busl 1 1
unlicense: spdx+unlicense: spdx license identifier unlicense
zlib: spdx+zlib: spdx license identifier zlib
cc0-1.0: spdx+cc0: spdx license identifier cc0 1 0
cc-by-4.0: spdx+cc: spdx license identifier cc by 4 0
cc-by-sa-4.0: spdx+cc+sa: spdx license identifier cc by sa 4 0
cc-by-nc-4.0: spdx+cc+nc: spdx license identifier cc by nc 4 0
eupl-1.2: spdx+eupl: spdx license identifier eupl 1 2
ofl-1.1: spdx+ofl: spdx license identifier ofl 1 1
apache-2: apache+licenses: (?:www )?apache org licenses license 2 0
apache-2: opensource+apache: opensource org licenses apache 2 0
mit: opensource+mit: opensource org licenses mit(?: license)?
isc: opensource+isc: opensource org licenses isc(?: license)?
bsd-2-clause: opensource+bsd: opensource org licenses bsd 2 clause
bsd-3-clause: opensource+bsd: opensource org licenses bsd 3 clause
gpl: gnu+licenses: (?:www )?gnu org licenses gpl(?: html| txt)?
gpl-3: gnu+licenses: (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
gpl-2: gnu+licenses: (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
lgpl: gnu+licenses+lgpl: (?:www )?gnu org licenses lgpl(?: html| txt)?
agpl-3: gnu+licenses+agpl: (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl: gnu+licenses+fdl: (?:www )?gnu org licenses fdl(?: 1 [123])?(?: html| txt)?
mpl-2: mozilla+mpl: mozilla org (?:en us )?mpl 2 0
unlicense: unlicense+org: unlicense org
cc0-1.0: creativecommons+publicdomain: creativecommons org publicdomain zero 1 0
cc-by-4.0: creativecommons+by: creativecommons org licenses by 4 0
cc-by-3.0: creativecommons+by: creativecommons org licenses by 3 0
cc-by-2.0: creativecommons+by: creativecommons org licenses by 2 [05]
cc-by-sa-4.0: creativecommons+sa: creativecommons org licenses by sa 4 0
cc-by-sa-3.0: creativecommons+sa: creativecommons org licenses by sa 3 0
cc-by-nd-4.0: creativecommons+nd: creativecommons org licenses by nd 4 0
cc-by-nc-4.0: creativecommons+nc: creativecommons org licenses by nc 4 0
cc-by-nc-3.0: creativecommons+nc: creativecommons org licenses by nc 3 0
cc-by-nc-sa-4.0: creativecommons+nc+sa: creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0: creativecommons+nc+sa: creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0: creativecommons+nc+nd: creativecommons org licenses by nc nd 4 0
odbl-1.0: opendatacommons+odbl: opendatacommons org licenses odbl(?: 1 0)?
wtfpl: wtfpl+net: wtfpl net
[name]
mit: mit+license/licence: mit licen[sc]e
mit: expat: expat licen[sc]e
isc: isc+license/licence: isc licen[sc]e
x11: x11+license/licence: x11 licen[sc]e
apache-2: apache+license/licence: apache(?: software)? licen[sc]e {v}2(?: 0)?
apache: apache+license/licence: apache(?: software)? licen[sc]e
gpl-3: gnu+general: gnu general public licen[sc]e {v}3(?: 0)?
gpl-2: gnu+general: gnu general public licen[sc]e {v}2(?: 0)?
gpl: gnu+general: gnu general public licen[sc]e
gpl: gnu+gpl: gnu gpl
gpl-3: gplv3: gplv3
gpl-2: gplv2: gplv2
lgpl-3: gnu+lesser: gnu lesser general public licen[sc]e {v}3(?: 0)?
lgpl-2.1: gnu+lesser: gnu lesser general public licen[sc]e {v}2 1
lgpl: gnu+lesser: gnu lesser general public licen[sc]e
lgpl-3: lgplv3: lgplv3
lgpl-2.1: lgplv2: lgplv2(?: 1)?
agpl-3: affero: (?:gnu )?affero general public licen[sc]e(?: {v}3(?: 0)?)?
agpl-3: agplv3: agplv3
gfdl: gnu+documentation: gnu free documentation licen[sc]e(?: {v}1 [123])?
mpl-2: mozilla+public: mozilla public licen[sc]e {v}2(?: 0)?
mpl: mozilla+public: mozilla public licen[sc]e
epl: eclipse+public: eclipse public licen[sc]e(?: {v}[12](?: 0)?)?
cddl-1: development+distribution: common development and distribution licen[sc]e
bsd-2-clause: bsd+clause: (?:2|two) clause bsd(?: licen[sc]e)?
bsd-3-clause: bsd+clause: (?:3|three) clause bsd(?: licen[sc]e)?
bsd: bsd+license/licence: bsd(?: style)? licen[sc]e
bsl-1.0: boost+software: boost software licen[sc]e
zlib: zlib+license/licence: zlib(?: libpng)? licen[sc]e
wtfpl: wtfpl: wtfpl
artistic: artistic+license/licence: artistic licen[sc]e(?: {v}[12](?: 0)?)?
python-2.0: python+foundation: python software foundation licen[sc]e
eupl: european+union: european union public licen[sc]e
ofl-1.1: sil+font: sil open font licen[sc]e
odbl-1.0: open+database: open database licen[sc]e
busl-1.1: business+source: business source licen[sc]e
sspl-1.0: server+side: server side public licen[sc]e
ogl-uk-3.0: open+government: open government licen[sc]e
cc-by-nc-nd: cc+nc+nd: cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa: cc+nc+sa: cc by nc sa(?: [1-4] [05])?
cc-by-nd: cc+nd: cc by nd(?: [1-4] [05])?
cc-by-sa: cc+sa: cc by sa(?: [1-4] [05])?
cc: creative+commons: creative commons licen[sc]e
[hint]
all-rights-reserved: rights+reserved: all rights reserved
unknown: license+terms: (?:subject to|see|read) the license terms
unknown: license+agreement: (?:end user|software) license agreement
unknown: license+file: see the license file(?: for details)?
public-domain: public+domain: in the public domain
copyleft: copyleft: copyleft(?: licen[sc]e)?
"""
