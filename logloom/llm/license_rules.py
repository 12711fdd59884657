"""Signature rules of the license scan: ``label priority score keyword pattern``, one a line.

Patterns are regular expressions over normalised text: lower-case words joined by one space, so
"Version 2.0" reads "version 2 0". They match whole words. The keyword must occur in every match;
a rule whose keyword is not in the text is not tried. Priorities: 4 whole license sentences,
3 named versions and grants, 2 identifiers and links, 1 bare names.
"""

SIGNATURES = r"""
mit 4 1.0 permission permission is hereby granted free of charge to any person obtaining a copy of this software
mit 3 0.95 mit (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit 3 0.95 mit (?:code|project|software|library|work|package) is (?:under )?(?:the )?mit licensed?
mit 2 0.95 spdx spdx license identifier mit
mit 2 0.9 opensource opensource org licenses? mit
mit 2 0.85 mit license mit
mit 1 0.8 mit (?:the )?mit licen[sc]e
mit 1 0.7 mit mit licensed
mit 1 0.7 expat expat licen[sc]e
mit-0 3 0.95 mit mit no attribution
mit-0 2 0.95 spdx spdx license identifier mit 0
x11 1 0.8 x11 x11 licen[sc]e
apache-2.0 4 1.0 apache licensed under the apache licen[sc]e version 2 0(?: the license you may not use this file except in compliance with the license)?
apache-2.0 4 1.0 apache licensed to the apache software foundation (?:asf )?under one or more contributor license agreements
apache-2.0 3 0.95 apache apache licen[sc]e (?:version |v ?)?2(?: 0)?
apache-2.0 3 0.95 apache apache software licen[sc]e (?:version |v ?)?2(?: 0)?
apache-2.0 3 0.9 apache apache v?2(?: 0)? licen[sc]ed?
apache-2.0 2 0.95 spdx spdx license identifier apache 2 0
apache-2.0 2 0.95 apache www apache org licenses license 2 0(?: txt| html)?
apache-2.0 2 0.9 apache asl 2 0 apache
apache-1.1 3 0.9 apache apache (?:software )?licen[sc]e (?:version |v ?)?1 1
apache-1.0 3 0.9 apache apache (?:software )?licen[sc]e (?:version |v ?)?1 0
apache 1 0.75 apache (?:the )?apache (?:software )?licen[sc]e
apache 1 0.6 apache apache licensed
gpl-3.0 4 1.0 general (?:this (?:work|program|software|file|project) is )?licensed under the (?:terms of the )?gnu general public licen[sc]e version 3(?: 0)?(?: or any later version)?
gpl-3.0 4 1.0 later either version 3 of the license or at your option any later version
gpl-3.0 3 0.95 general gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?
gpl-3.0 3 0.9 gpl (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?(?: or later)?
gpl-3.0 3 0.9 gplv3 gplv3(?: or later)?
gpl-3.0 2 0.95 spdx spdx license identifier gpl 3 0(?: only| or later)?
gpl-3.0 2 0.9 gnu gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl-2.0 4 1.0 general (?:this (?:work|program|software|file|project) is )?licensed under the (?:terms of the )?gnu general public licen[sc]e version 2(?: 0)?(?: or any later version)?
gpl-2.0 4 1.0 later either version 2 of the license or at your option any later version
gpl-2.0 3 0.95 general gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)?
gpl-2.0 3 0.9 gpl (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?(?: or later)?
gpl-2.0 3 0.9 gplv2 gplv2(?: or later)?
gpl-2.0 2 0.95 spdx spdx license identifier gpl 2 0(?: only| or later)?
gpl-2.0 2 0.9 gnu gnu org licenses old licenses gpl 2 0(?: en)?(?: html| txt)?
gpl-1.0 3 0.9 general gnu general public licen[sc]e (?:version |v ?)1(?: 0)?
gpl 3 0.85 redistribute this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 1 0.75 general (?:the )?(?:gnu )?general public licen[sc]e
gpl 1 0.7 gpl (?:gnu )?gpl licen[sc]ed?
gpl 1 0.65 gnu gnu gpl
gpl-classpath-exception 3 0.9 classpath (?:gpl )?(?:with )?(?:the )?classpath exception
gpl-gcc-exception 3 0.9 gcc gcc runtime library exception
gpl-font-exception 3 0.9 font gpl (?:with )?font exception
lgpl-3.0 4 1.0 lesser licensed under the (?:terms of the )?gnu lesser general public licen[sc]e version 3(?: 0)?
lgpl-3.0 3 0.95 lesser (?:gnu )?lesser general public licen[sc]e (?:version |v ?)3(?: 0)?
lgpl-3.0 3 0.9 lgpl lgpl ?(?:version |v ?)?3(?: 0)?(?: or later)?
lgpl-3.0 3 0.9 lgplv3 lgplv3
lgpl-3.0 2 0.95 spdx spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 4 1.0 lesser licensed under the (?:terms of the )?gnu lesser general public licen[sc]e version 2 1
lgpl-2.1 3 0.95 lesser (?:gnu )?lesser general public licen[sc]e (?:version |v ?)2 1
lgpl-2.1 3 0.9 lgpl lgpl ?(?:version |v ?)?2 1(?: or later)?
lgpl-2.1 2 0.95 spdx spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.0 3 0.9 library (?:gnu )?library general public licen[sc]e(?: version 2(?: 0)?)?
lgpl 1 0.75 lesser (?:gnu )?lesser general public licen[sc]e
lgpl 1 0.65 lgpl (?:gnu )?lgpl
agpl-3.0 4 1.0 affero licensed under the (?:terms of the )?gnu affero general public licen[sc]e version 3(?: 0)?
agpl-3.0 3 0.95 affero (?:gnu )?affero general public licen[sc]e (?:version |v ?)3(?: 0)?
agpl-3.0 3 0.9 agpl agpl ?(?:version |v ?)?3(?: 0)?(?: or later)?
agpl-3.0 3 0.9 agplv3 agplv3
agpl-3.0 2 0.95 spdx spdx license identifier agpl 3 0(?: only| or later)?
agpl 1 0.75 affero (?:gnu )?affero general public licen[sc]e
agpl 1 0.65 agpl (?:gnu )?agpl
gfdl-1.3 3 0.95 documentation gnu free documentation licen[sc]e (?:version |v ?)?1 3
gfdl-1.2 3 0.95 documentation gnu free documentation licen[sc]e (?:version |v ?)?1 2
gfdl-1.1 3 0.95 documentation gnu free documentation licen[sc]e (?:version |v ?)?1 1
gfdl 1 0.8 documentation (?:gnu )?free documentation licen[sc]e
gfdl 1 0.7 gfdl gfdl
bsd-3-clause 4 1.0 endorse neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause 3 0.95 bsd (?:the )?bsd 3 clause(?: licen[sc]e)?
bsd-3-clause 3 0.95 bsd (?:the )?3 clause bsd(?: licen[sc]e)?
bsd-3-clause 3 0.9 bsd (?:new|modified|revised) bsd(?: licen[sc]e)?
bsd-3-clause 2 0.95 spdx spdx license identifier bsd 3 clause
bsd-3-clause 2 0.9 opensource opensource org licenses? bsd 3 clause
bsd-2-clause 3 0.95 bsd (?:the )?bsd 2 clause(?: licen[sc]e)?
bsd-2-clause 3 0.95 bsd (?:the )?2 clause bsd(?: licen[sc]e)?
bsd-2-clause 3 0.9 bsd simplified bsd(?: licen[sc]e)?
bsd-2-clause 2 0.95 spdx spdx license identifier bsd 2 clause
bsd-2-clause 2 0.9 opensource opensource org licenses? bsd 2 clause
bsd-4-clause 3 0.95 bsd (?:the )?(?:bsd 4 clause|4 clause bsd)(?: licen[sc]e)?
bsd-4-clause 3 0.9 advertising all advertising materials mentioning features or use of this software must display
bsd-0-clause 3 0.95 bsd (?:bsd 0 clause|zero clause bsd|0bsd)(?: licen[sc]e)?
bsd-0-clause 2 0.95 0bsd spdx license identifier 0bsd
bsd 4 0.9 redistribution redistribution and use in source and binary forms with or without modification are permitted
bsd 1 0.75 bsd (?:the )?bsd (?:style )?licen[sc]ed?
isc 4 1.0 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 2 0.95 spdx spdx license identifier isc
isc 1 0.8 isc (?:the )?isc licen[sc]ed?
mpl-2.0 4 1.0 mozilla this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 3 0.95 mozilla mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?
mpl-2.0 2 0.95 spdx spdx license identifier mpl 2 0
mpl-2.0 2 0.9 mozilla (?:www )?mozilla org mpl 2 0
mpl-2.0 2 0.85 mpl mpl ?(?:version |v ?)?2 0
mpl-1.1 3 0.95 mozilla mozilla public licen[sc]e (?:version |v ?)?1 1
mpl-1.1 2 0.95 spdx spdx license identifier mpl 1 1
mpl-1.0 3 0.95 mozilla mozilla public licen[sc]e (?:version |v ?)?1 0
mpl 1 0.75 mozilla mozilla public licen[sc]e
epl-2.0 3 0.95 eclipse eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?
epl-2.0 2 0.95 spdx spdx license identifier epl 2 0
epl-1.0 3 0.95 eclipse eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?
epl-1.0 2 0.95 spdx spdx license identifier epl 1 0
epl 1 0.75 eclipse eclipse public licen[sc]e
edl-1.0 1 0.8 eclipse eclipse distribution licen[sc]e(?: v? ?1 0)?
cddl-1.1 3 0.95 common common development and distribution licen[sc]e (?:version |v ?)?1 1
cddl-1.0 3 0.95 common common development and distribution licen[sc]e (?:version |v ?)?1 0
cddl-1.0 2 0.95 spdx spdx license identifier cddl 1 0
cddl 1 0.75 common common development and distribution licen[sc]e
cpl-1.0 1 0.85 common common public licen[sc]e(?: version)?(?: v? ?1 0)?
ipl-1.0 1 0.85 ibm ibm public licen[sc]e(?: version)?(?: v? ?1 0)?
eupl-1.2 3 0.95 european european union public licen[sc]e (?:version |v ?)?1 2
eupl-1.1 3 0.95 european european union public licen[sc]e (?:version |v ?)?1 1
eupl-1.2 2 0.9 eupl eupl ?(?:version |v ?)?1 2
eupl 1 0.75 european european union public licen[sc]e
cecill-2.1 3 0.95 cecill cecill ?(?:version |v ?)?2 1
cecill-b 1 0.9 cecill cecill b
cecill-c 1 0.9 cecill cecill c
cecill 1 0.75 cecill cecill(?: free software)?(?: licen[sc]e)?
artistic-2.0 3 0.95 artistic artistic licen[sc]e (?:version |v ?)?2(?: 0)?
artistic-2.0 2 0.95 spdx spdx license identifier artistic 2 0
artistic-1.0 3 0.95 artistic artistic licen[sc]e (?:version |v ?)?1(?: 0)?
artistic 1 0.75 artistic (?:perl )?artistic licen[sc]e
zlib 4 1.0 misrepresented the origin of this software must not be misrepresented
zlib 2 0.95 spdx spdx license identifier zlib
zlib 1 0.8 zlib zlib(?: libpng)? licen[sc]e
libpng 1 0.8 libpng libpng licen[sc]e
bsl-1.0 4 1.0 boost distributed under the boost software license version 1 0
bsl-1.0 3 0.95 boost boost software licen[sc]e(?: (?:version |v ?)?1 0)?
bsl-1.0 2 0.95 spdx spdx license identifier bsl 1 0
bsl-1.0 2 0.9 boost (?:www )?boost org license 1 0 txt
busl-1.1 3 0.95 business business source licen[sc]e(?: (?:version |v ?)?1 1)?
busl-1.1 2 0.95 spdx spdx license identifier busl 1 1
unlicense 4 1.0 unencumbered this is free and unencumbered software released into the public domain
unlicense 2 0.95 spdx spdx license identifier unlicense
unlicense 2 0.9 unlicense (?:www )?unlicense org
unlicense 1 0.8 unlicense (?:the )?unlicense
wtfpl 3 0.95 fuck do what the fuck you want to(?: public licen[sc]e)?
wtfpl 1 0.8 wtfpl wtfpl
cc0-1.0 4 1.0 cc0 (?:licensed|released|dedicated) (?:under|to) (?:the )?cc0(?: 1 0)?(?: universal)?
cc0-1.0 3 0.95 creative creative commons (?:zero|cc0|0)(?: 1 0)?(?: universal)?
cc0-1.0 3 0.95 cc0 cc0 1 0(?: universal)?
cc0-1.0 2 0.95 publicdomain creativecommons org publicdomain zero 1 0
cc0-1.0 1 0.8 cc0 cc0
public-domain-mark 2 0.9 publicdomain creativecommons org publicdomain mark 1 0
cc-by-4.0 4 1.0 cc licensed under (?:a |the )?cc by 4 0
cc-by-4.0 3 0.95 cc cc by 4 0
cc-by-4.0 3 0.95 creative creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
cc-by-4.0 2 0.95 creativecommons creativecommons org licenses by 4 0
cc-by-3.0 3 0.95 cc cc by 3 0
cc-by-3.0 3 0.95 creative creative commons attribution 3 0(?: unported)?(?: licen[sc]e)?
cc-by-3.0 2 0.95 creativecommons creativecommons org licenses by 3 0
cc-by-2.5 3 0.95 cc cc by 2 5
cc-by-2.5 2 0.95 creativecommons creativecommons org licenses by 2 5
cc-by-2.0 3 0.95 cc cc by 2 0
cc-by-2.0 2 0.95 creativecommons creativecommons org licenses by 2 0
cc-by 1 0.75 cc (?:licensed under )cc by
cc-by 1 0.75 creative creative commons attribution(?: licen[sc]e)
cc-by-sa-4.0 4 1.0 cc licensed under (?:a |the )?cc by sa 4 0
cc-by-sa-4.0 3 0.95 cc cc by sa 4 0
cc-by-sa-4.0 3 0.95 creative creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa-4.0 2 0.95 creativecommons creativecommons org licenses by sa 4 0
cc-by-sa-3.0 3 0.95 cc cc by sa 3 0
cc-by-sa-3.0 3 0.95 creative creative commons attribution share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa-3.0 2 0.95 creativecommons creativecommons org licenses by sa 3 0
cc-by-sa-2.5 3 0.95 cc cc by sa 2 5
cc-by-sa-2.0 3 0.95 cc cc by sa 2 0
cc-by-sa 1 0.75 cc cc by sa
cc-by-sa 1 0.75 creative creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-nc-4.0 4 1.0 cc licensed under (?:a |the )?cc by nc 4 0
cc-by-nc-4.0 3 0.95 cc cc by nc 4 0
cc-by-nc-4.0 3 0.95 creative creative commons attribution non ?commercial 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-4.0 2 0.95 creativecommons creativecommons org licenses by nc 4 0
cc-by-nc-3.0 3 0.95 cc cc by nc 3 0
cc-by-nc-3.0 2 0.95 creativecommons creativecommons org licenses by nc 3 0
cc-by-nc-2.0 3 0.95 cc cc by nc 2 0
cc-by-nc 1 0.75 cc cc by nc
cc-by-nc 1 0.75 creative creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nd-4.0 3 0.95 cc cc by nd 4 0
cc-by-nd-4.0 3 0.95 creative creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[sc]e)?
cc-by-nd-4.0 2 0.95 creativecommons creativecommons org licenses by nd 4 0
cc-by-nd-3.0 3 0.95 cc cc by nd 3 0
cc-by-nd 1 0.75 cc cc by nd
cc-by-nc-sa-4.0 4 1.0 cc licensed under (?:a |the )?cc by nc sa 4 0
cc-by-nc-sa-4.0 3 0.95 cc cc by nc sa 4 0
cc-by-nc-sa-4.0 3 0.95 creative creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-sa-4.0 2 0.95 creativecommons creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 3 0.95 cc cc by nc sa 3 0
cc-by-nc-sa-3.0 2 0.95 creativecommons creativecommons org licenses by nc sa 3 0
cc-by-nc-sa 1 0.75 cc cc by nc sa
cc-by-nc-nd-4.0 4 1.0 cc licensed under (?:a |the )?cc by nc nd 4 0
cc-by-nc-nd-4.0 3 0.95 cc cc by nc nd 4 0
cc-by-nc-nd-4.0 3 0.95 creative creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-nd-4.0 2 0.95 creativecommons creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 3 0.95 cc cc by nc nd 3 0
cc-by-nc-nd 1 0.75 cc cc by nc nd
cc 1 0.6 creative creative commons licen[sc]e
cc 1 0.55 creative (?:licensed|released|published) under (?:a )?creative commons
odbl-1.0 3 0.95 odbl (?:licensed under )?(?:the )?odbl(?: 1 0)?
odbl-1.0 1 0.85 database open (?:data commons open )?database licen[sc]e
odc-by-1.0 1 0.85 commons open data commons attribution licen[sc]e
pddl-1.0 1 0.85 commons open data commons public domain dedication(?: and licen[sc]e)?
ofl-1.1 4 1.0 font this font software is licensed under the sil open font license version 1 1
ofl-1.1 3 0.95 font (?:sil )?open font licen[sc]e(?: (?:version |v ?)?1 1)?
ofl-1.1 2 0.95 spdx spdx license identifier ofl 1 1
python-2.0 3 0.95 python python software foundation licen[sc]e(?: (?:version |v ?)?2)?
python-2.0 3 0.95 psf psf licen[sc]e(?: (?:version |v ?)?2)?
python-2.0 2 0.95 spdx spdx license identifier (?:psf|python) 2 0
php-3.01 3 0.95 php php licen[sc]e (?:version |v ?)?3 0?1
php 1 0.75 php (?:the )?php licen[sc]e
ruby 1 0.75 ruby (?:the )?ruby licen[sc]e
perl 2 0.85 perl (?:under )?the same terms as perl(?: itself)?
postgresql 1 0.85 postgresql (?:the )?postgresql licen[sc]e
openssl 1 0.8 openssl (?:the )?openssl licen[sc]e
ssleay 1 0.8 ssleay (?:the )?ssleay licen[sc]e
curl 1 0.8 curl (?:the )?curl licen[sc]e
ncsa 3 0.95 illinois university of illinois(?: ncsa)? open source licen[sc]e
ncsa 1 0.8 ncsa ncsa(?: open source)? licen[sc]e
afl-3.0 3 0.95 academic academic free licen[sc]e (?:version |v ?)?3 0
afl-2.1 3 0.95 academic academic free licen[sc]e (?:version |v ?)?2 1
afl 1 0.75 academic academic free licen[sc]e
osl-3.0 3 0.95 open open software licen[sc]e (?:version |v ?)?3 0
osl 1 0.7 open open software licen[sc]e
ms-pl 1 0.9 microsoft microsoft public licen[sc]e
ms-rl 1 0.9 microsoft microsoft reciprocal licen[sc]e
apsl-2.0 1 0.85 apple apple public source licen[sc]e(?: (?:version |v ?)?2 0)?
sun-bcla 1 0.8 binary sun (?:microsystems )?binary code licen[sc]e
spl-1.0 1 0.8 sun sun public licen[sc]e
qpl-1.0 1 0.85 public (?:the )?q public licen[sc]e(?: (?:version |v ?)?1 0)?
w3c 1 0.85 w3c w3c software (?:notice and )?licen[sc]e
unicode 1 0.85 unicode unicode (?:inc )?licen[sc]e(?: agreement)?
vim 1 0.8 vim (?:the )?vim licen[sc]e
beerware 1 0.85 beer (?:the )?beer ?ware(?: licen[sc]e)?
json 2 0.9 evil the software shall be used for good not evil
json 1 0.8 json (?:the )?json licen[sc]e
sspl-1.0 1 0.9 server server side public licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?
elastic-2.0 1 0.9 elastic elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?
commons-clause 1 0.85 clause commons clause(?: licen[sc]e)?(?: condition)?
confluent 1 0.8 confluent confluent community licen[sc]e
polyform 1 0.85 polyform polyform (?:noncommercial|small business|shield|strict|perimeter)(?: licen[sc]e)?(?: 1 0 0)?
bigscience-rail 1 0.9 bigscience bigscience (?:open )?rail(?: m)?(?: licen[sc]e)?
openrail 1 0.85 openrail (?:creativeml )?openrail(?: m)?(?: licen[sc]e)?
llama 1 0.85 llama llama (?:2|3)?(?: 1)? ?community licen[sc]e(?: agreement)?
nist 1 0.8 nist nist software licen[sc]e
mulan-2.0 1 0.9 mulan mulan (?:psl|permissive software licen[sc]e) ?(?:v ?)?2
blueoak-1.0.0 1 0.9 blue blue oak model licen[sc]e(?: 1 0 0)?
cern-ohl 1 0.85 cern cern open hardware licen[sc]e
ogl-uk-3.0 1 0.9 government open government licen[sc]e(?: v? ?3 0)?
etalab-2.0 1 0.85 etalab (?:licence ouverte )?etalab(?: 2 0)?
dl-de-by-2.0 1 0.85 deutschland datenlizenz deutschland (?:namensnennung )?2 0
public-domain 3 0.9 domain (?:released|placed|dedicated|put|is) (?:in|into|to) the public domain
public-domain 1 0.6 domain (?:this (?:work|file|software) is )?public domain
all-rights-reserved 1 0.6 rights all rights reserved
proprietary 2 0.8 proprietary (?:this (?:software|document|work) is )?(?:confidential and proprietary|proprietary and confidential)
proprietary 2 0.8 unauthorized unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|work)
proprietary 1 0.6 proprietary proprietary licen[sc]e
non-commercial 1 0.6 commercial for non ?commercial (?:use|purposes) only
no-ai-training 2 0.8 training (?:not|no) (?:be )?(?:used )?for (?:ai|machine learning|model) training
"""


def signatures() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, score, keyword, pattern) of every rule, in order."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, score, keyword, pattern = line.split(" ", 4)
        out.append((label, int(priority), float(score), keyword, pattern))
    return out
