"""Hand-written signature rules of licenses.

A rule stands on a line: kind, label, the words that a text must hold before
the rule is tried (joined by commas), and a regular expression over the words
of a text, in lower case and one blank apart ("GPL-2.0+" is ``gpl 2 0``).
Kinds are ordered: of overlapping finds the one of an earlier kind prevails.
"""

from __future__ import annotations

#: Kinds in order of priority, with how sure a find is.
KINDS = {"tag": 0.98, "text": 0.95, "notice": 0.9, "url": 0.8, "name": 0.7, "mention": 0.5}

RULES = r"""
tag mit spdx,mit                      spdx license identifier mit
tag mit-0 spdx,mit                    spdx license identifier mit 0
tag isc spdx,isc                      spdx license identifier isc
tag 0bsd spdx,0bsd                    spdx license identifier 0bsd
tag bsd-2-clause spdx,bsd             spdx license identifier bsd 2 clause
tag bsd-3-clause spdx,bsd             spdx license identifier bsd 3 clause
tag bsd-4-clause spdx,bsd             spdx license identifier bsd 4 clause
tag apache-1.1 spdx,apache            spdx license identifier apache 1 1
tag apache-2.0 spdx,apache            spdx license identifier apache 2 0
tag gpl-2.0-only spdx,gpl             spdx license identifier gpl 2 0(?: only)?
tag gpl-2.0-or-later spdx,gpl         spdx license identifier gpl 2 0 or later
tag gpl-3.0-only spdx,gpl             spdx license identifier gpl 3 0(?: only)?
tag gpl-3.0-or-later spdx,gpl         spdx license identifier gpl 3 0 or later
tag lgpl-2.0-or-later spdx,lgpl       spdx license identifier lgpl 2 0 or later
tag lgpl-2.1-only spdx,lgpl           spdx license identifier lgpl 2 1(?: only)?
tag lgpl-2.1-or-later spdx,lgpl       spdx license identifier lgpl 2 1 or later
tag lgpl-3.0-only spdx,lgpl           spdx license identifier lgpl 3 0(?: only)?
tag lgpl-3.0-or-later spdx,lgpl       spdx license identifier lgpl 3 0 or later
tag agpl-3.0-only spdx,agpl           spdx license identifier agpl 3 0(?: only)?
tag agpl-3.0-or-later spdx,agpl       spdx license identifier agpl 3 0 or later
tag mpl-1.1 spdx,mpl                  spdx license identifier mpl 1 1
tag mpl-2.0 spdx,mpl                  spdx license identifier mpl 2 0(?: no copyleft exception)?
tag epl-1.0 spdx,epl                  spdx license identifier epl 1 0
tag epl-2.0 spdx,epl                  spdx license identifier epl 2 0
tag eupl-1.2 spdx,eupl                spdx license identifier eupl 1 2
tag cddl-1.0 spdx,cddl                spdx license identifier cddl 1 0
tag cddl-1.1 spdx,cddl                spdx license identifier cddl 1 1
tag cc0-1.0 spdx,cc0                  spdx license identifier cc0 1 0
tag cc-by-4.0 spdx,cc                 spdx license identifier cc by 4 0
tag cc-by-sa-4.0 spdx,cc              spdx license identifier cc by sa 4 0
tag cc-by-nc-4.0 spdx,cc              spdx license identifier cc by nc 4 0
tag cc-by-nc-sa-4.0 spdx,cc           spdx license identifier cc by nc sa 4 0
tag cc-by-3.0 spdx,cc                 spdx license identifier cc by 3 0
tag cc-by-sa-3.0 spdx,cc              spdx license identifier cc by sa 3 0
tag bsl-1.0 spdx,bsl                  spdx license identifier bsl 1 0
tag zlib spdx,zlib                    spdx license identifier zlib
tag unlicense spdx,unlicense          spdx license identifier unlicense
tag wtfpl spdx,wtfpl                  spdx license identifier wtfpl
tag artistic-2.0 spdx,artistic        spdx license identifier artistic 2 0
tag postgresql spdx,postgresql        spdx license identifier postgresql
tag python-2.0 spdx,python            spdx license identifier python 2 0
tag ofl-1.1 spdx,ofl                  spdx license identifier ofl 1 1
tag upl-1.0 spdx,upl                  spdx license identifier upl 1 0
tag mulanpsl-2.0 spdx,mulanpsl        spdx license identifier mulanpsl 2 0
tag sspl-1.0 spdx,sspl                spdx license identifier sspl 1 0
tag busl-1.1 spdx,busl                spdx license identifier busl 1 1
tag elastic-2.0 spdx,elastic          spdx license identifier elastic 2 0

text mit granted,hereby,charge        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text mit sublicense,merge             to use copy modify merge publish distribute sublicense and or sell copies of the software
text x11 granted,hereby,charge        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software(?: \S+){1,120} x consortium
text isc granted,fee,purpose          permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
text 0bsd granted,fee,purpose         permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
text bsd-2-clause redistributions     redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text bsd-2-clause redistributions     redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
text bsd-3-clause endorse,derived     neither the names? of (?:\S+ ){1,14}nor the names of (?:its|their|other) contributors may be used to endorse or promote products derived from this software
text bsd-3-clause endorse,derived     the names? of (?:\S+ ){1,14}may not be used to endorse or promote products derived from this software without specific prior written permission
text bsd-4-clause advertising         all advertising materials mentioning features or use of this software must display the following acknowledge?ment
text apache-1.0 redistributions,apache redistributions of any form whatsoever must retain the following acknowledgment(?: \S+){1,20} apache
text apache-1.1 redistribution,apache the end user documentation included with the redistribution(?: \S+){1,30} apache software foundation
text apache-2.0 apache,january        apache license version 2 0 january 2004(?: \S+){0,20}
text apache-2.0 perpetual,contributor each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of
text gpl-1.0 gnu,1989                 gnu general public license version 1 february 1989
text gpl-2.0 gnu,1991                 gnu general public license version 2 june 1991
text gpl-3.0 gnu,2007                 gnu general public license version 3 29 june 2007
text lgpl-2.0 gnu,1991                gnu library general public license version 2 june 1991
text lgpl-2.1 gnu,1999                gnu lesser general public license version 2 1 february 1999
text lgpl-3.0 gnu,2007                gnu lesser general public license version 3 29 june 2007
text agpl-3.0 gnu,2007                gnu affero general public license version 3 19 november 2007
text agpl-1.0 affero,2002             affero general public license version 1 march 2002
text gpl freedom,licenses             the licenses for most software are designed to take away your freedom to share and change it
text gpl-3.0 copyleft                 the gnu general public license is a free copyleft license for software and other kinds of works
text lgpl-3.0 incorporates,lesser     this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
text gfdl-1.1 gnu,2000                gnu free documentation license version 1 1 march 2000
text gfdl-1.2 gnu,2002                gnu free documentation license version 1 2 november 2002
text gfdl-1.3 gnu,2008                gnu free documentation license version 1 3 3 november 2008
text mpl-1.0 mozilla                  mozilla public license version 1 0 1 definitions
text mpl-1.1 mozilla                  mozilla public license version 1 1 1 definitions
text mpl-2.0 mozilla                  mozilla public license version 2 0 1 definitions
text epl-1.0 accompanying,eclipse     the accompanying program is provided under the terms of this eclipse public license(?! \S{0,3}version 2)
text epl-2.0 accompanying,eclipse     the accompanying program is provided under the terms of this eclipse public license(?: \S+){0,2} v(?:ersion )?2
text cpl-1.0 accompanying,common      the accompanying program is provided under the terms of this common public license
text ipl-1.0 accompanying,ibm         the accompanying program is provided under the terms of this ibm public license
text cddl-1.0 cddl,common             common development and distribution license cddl version 1 0 1 definitions
text cddl-1.1 cddl,common             common development and distribution license cddl version 1 1 1 definitions
text cc0-1.0 waives,affirmer          affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
text cc-by-4.0 creative,attribution   creative commons attribution 4 0 international public license
text cc-by-sa-4.0 creative,attribution creative commons attribution sharealike 4 0 international public license
text cc-by-nc-4.0 creative,attribution creative commons attribution noncommercial 4 0 international public license
text cc-by-nd-4.0 creative,attribution creative commons attribution noderivatives 4 0 international public license
text cc-by-nc-sa-4.0 creative,attribution creative commons attribution noncommercial sharealike 4 0 international public license
text cc-by-nc-nd-4.0 creative,attribution creative commons attribution noncommercial noderivatives 4 0 international public license
text unlicense unencumbered           this is free and unencumbered software released into the public domain
text wtfpl fuck,public                do what the fuck you want to public license
text zlib origin,misrepresented       the origin of this software must not be misrepresented you must not claim that you wrote the original software
text zlib altered,misrepresented      altered source versions must be plainly marked as such and must not be misrepresented as being the original software
text libpng contributing,42           the contributing authors and group 42 inc disclaim all warranties
text bsl-1.0 boost,august             boost software license version 1 0 august 17th 2003
text artistic-1.0 artistic,preamble   the artistic license preamble the intent of this document is to state the conditions under which a package may be copied
text artistic-2.0 artistic,2000       the artistic license 2 0 copyright c 2000 2006 the perl foundation
text python-2.0 python,foundation            python software foundation license version 2 1 this license agreement is between the python software foundation
text cnri-python national,initiatives          this license agreement is between the corporation for national research initiatives
text ruby verbatim,duplicate       you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices
text php-3.0 php,license      the php license version 3 0 copyright
text php-3.01 php,license     the php license version 3 01 copyright
text openssl openssl,toolkit          this product includes software developed by the openssl project for use in the openssl toolkit
text openldap openldap,2003           the openldap public license version 2 8 17 august 2003
text curl fee,notice                  permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
text ncsa urbana,illinois             neither the names of(?: \S+){1,20} university of illinois at urbana champaign
text postgresql written,fee        permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
text ofl-1.0 sil,2005                 sil open font license version 1 0 22 november 2005
text ofl-1.1 sil,2007                 sil open font license version 1 1 26 february 2007
text eupl-1.1 european,eupl           european union public licence v 1 1 eupl
text eupl-1.2 european,eupl           european union public licence v 1 2 eupl
text odbl-1.0 odbl,database           odc open database license odbl
text odc-by-1.0 odc,attribution       odc attribution license odc by
text pddl-1.0 pddl                    odc public domain dedication and licence pddl
text ms-pl microsoft,pl       microsoft public license ms pl this license governs use of the accompanying software
text ms-rl microsoft,reciprocal       microsoft reciprocal license ms rl this license governs use of the accompanying software
text json good,evil                   the software shall be used for good not evil
text beerware beer,meet               if we meet some day and you think this stuff is worth it you can buy me a beer in return
text fair instrument,works            usage of the works is permitted provided that this instrument is retained with the works
text blueoak-1.0.0 contributor,infringe each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright in it
text upl-1.0 universal,upl               the universal permissive license upl version 1 0 subject to the condition set forth below
text mulanpsl-2.0 mulan               mulan permissive software license version 2 january 2020
text elastic-2.0 hosted,managed      you may not provide the software to third parties as a hosted or managed service
text sspl-1.0 server,2018             server side public license version 1 october 16 2018
text busl-1.1 licensor,production     the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
text commons-clause grant,sell    the grant of rights under the license will not include and the license does not grant to you the right to sell the software
text polyform-noncommercial noncommercial polyform noncommercial license 1 0 0
text polyform-small-business polyform polyform small business license 1 0 0
text lppl-1.3c latex,lppl             the latex project public license lppl version 1 3c
text sleepycat redistributions,db redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
text hpnd documentation,fee           permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
text ftl freetype,2006                the freetype project license 2006 jan 27
text ijg independent,jpeg             this software is based in part on the work of the independent jpeg group
text w3c w3c,notice                   w3c software notice and license
text unicode data,unicode             unicode license agreement data files and software
text afl-3.0 academic,licensed        licensed under the academic free license version 3 0
text osl-3.0 open,licensed            licensed under the open software license version 3 0
text ecl-2.0 educational              educational community license version 2 0 april 2007
text cecill-2.1 cecill                cecill free software license agreement version 2 1
text qpl-1.0 trolltech                the q public license version 1 0 copyright c 1999 trolltech
text apsl-2.0 apple,2003              apple public source license version 2 0 august 6 2003
text vim vim,charityware             vim is charityware
text tcl regents,scriptics            this software is copyrighted by the regents of the university of california sun microsystems inc scriptics corporation

notice gpl-2.0-or-later gnu,redistribute  redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
notice gpl-3.0-or-later gnu,redistribute  redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
notice gpl-2.0-only gnu,redistribute      redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation
notice lgpl-2.0-or-later gnu,library      under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
notice lgpl-2.1-or-later gnu,lesser       under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
notice lgpl-3.0-or-later gnu,lesser       under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
notice agpl-3.0-or-later affero           under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
notice agpl-3.0-only affero               under the terms of the gnu affero general public license version 3 as published
notice gfdl-1.3 gnu,documentation         permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
notice gfdl-1.2 gnu,documentation         permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
notice apache-2.0 apache,licensed         licensed under the apache license version 2 0(?: the license)?
notice apache-2.0 apache,licensed         licensed to the apache software foundation asf under one or more contributor license agreements
notice mpl-1.1 mozilla,contents           the contents of this file are subject to the mozilla public license version 1 1
notice mpl-2.0 mozilla,subject            this source code form is subject to the terms of the mozilla public license v 2 0
notice epl-1.0 eclipse,accompanies       made available under the terms of the eclipse public license v ?1 0 which accompanies this distribution
notice epl-2.0 eclipse,available          made available under the terms of the eclipse public license (?:v )?2 0
notice cddl-1.0 development,distribution  the contents of this file are subject to the terms of the common development and distribution license
notice bsl-1.0 boost,distributed          distributed under the boost software license version 1 0
notice eupl-1.2 eupl,licensed             licensed under the eupl(?: version)? 1 2(?: or later)?
notice mit mit,licensed                   (?:licensed|released|distributed|available) under the(?: terms of the)? mit licen[sc]e
notice mit mit,copyright                  mit licensed? copyright c(?: \d{4})?
notice isc isc,licensed                   (?:licensed|released|distributed|available) under the(?: terms of the)? isc licen[sc]e
notice bsd bsd,license                    use of this source code is governed by a bsd style license
notice bsd bsd,under                      (?:licensed|released|distributed|available) under the(?: terms of the)? bsd licen[sc]e
notice bsd-3-clause bsd,under             (?:licensed|released|distributed|available) under the(?: terms of the)? (?:bsd 3 clause|3 clause bsd) licen[sc]e
notice bsd-2-clause bsd,under             (?:licensed|released|distributed|available) under the(?: terms of the)? (?:bsd 2 clause|2 clause bsd) licen[sc]e
notice cc0-1.0 cc0,dedicated              (?:dedicated to the public domain|released) under (?:the )?cc0
notice cc-by-4.0 creative,attribution     under (?:a|the) creative commons attribution 4 0(?: international)? license
notice cc-by-sa-4.0 creative,attribution  under (?:a|the) creative commons attribution share ?alike 4 0(?: international)? license
notice cc-by-nc-4.0 creative,attribution  under (?:a|the) creative commons attribution non ?commercial 4 0(?: international)? license
notice cc-by-3.0 creative,attribution     under (?:a|the) creative commons attribution 3 0(?: unported)? license
notice cc-by-sa-3.0 creative,attribution  under (?:a|the) creative commons attribution share ?alike 3 0(?: unported)? license
notice cc-by-2.0 creative,attribution     under (?:a|the) creative commons attribution 2 0(?: generic)? license
notice public-domain public,domain        (?:released|placed|dedicated) (?:into|in|to) the public domain
notice artistic-1.0-perl perl,terms       (?:redistribute|modify) it under the same terms as perl itself
notice proprietary proprietary,confidential proprietary and confidential
notice proprietary prohibited,unauthorized    unauthorized (?:copying|use|reproduction|distribution) of this (?:file|document|software)(?: \S+){0,6} is strictly prohibited

url mit opensource,mit                opensource org licen[sc]es?(?: licenses)? mit(?: license)?(?: php| html)?
url bsd-3-clause opensource,bsd       opensource org licenses? bsd 3 clause
url bsd-2-clause opensource,bsd       opensource org licenses? bsd 2 clause
url isc opensource,isc                opensource org licenses? isc
url gpl-2.0 opensource,gpl            opensource org licenses? gpl 2 0
url gpl-3.0 opensource,gpl            opensource org licenses? gpl 3 0
url apache-2.0 apache,licenses        apache org licenses license 2 0
url apache-1.1 apache,licenses        apache org licenses license 1 1
url gpl gnu,licenses                  gnu org licenses gpl(?: html| txt)?
url gpl-2.0 gnu,licenses              gnu org licenses(?: old licenses)? gpl 2 0
url gpl-3.0 gnu,licenses              gnu org licenses gpl 3 0
url lgpl gnu,licenses                 gnu org licenses lgpl(?: html| txt)?
url lgpl-2.1 gnu,licenses             gnu org licenses(?: old licenses)? lgpl 2 1
url lgpl-3.0 gnu,licenses             gnu org licenses lgpl 3 0
url agpl-3.0 gnu,licenses             gnu org licenses agpl(?: 3 0)?(?: html| txt)?
url gfdl gnu,licenses                 gnu org (?:licenses|copyleft) fdl
url mpl-1.1 mozilla,mpl               mozilla org mpl(?: mpl)? 1 1
url mpl-2.0 mozilla,mpl               mozilla org mpl 2 0
url epl-1.0 eclipse,legal             eclipse org legal epl v10
url epl-2.0 eclipse,legal             eclipse org legal epl 2 0
url cc0-1.0 creativecommons,zero      creativecommons org publicdomain zero 1 0
url pdm-1.0 creativecommons,mark      creativecommons org publicdomain mark 1 0
url cc-by-4.0 creativecommons,by      creativecommons org licenses by 4 0
url cc-by-sa-4.0 creativecommons,sa   creativecommons org licenses by sa 4 0
url cc-by-nd-4.0 creativecommons,nd   creativecommons org licenses by nd 4 0
url cc-by-nc-4.0 creativecommons,nc   creativecommons org licenses by nc 4 0
url cc-by-nc-sa-4.0 creativecommons,nc creativecommons org licenses by nc sa 4 0
url cc-by-nc-nd-4.0 creativecommons,nc creativecommons org licenses by nc nd 4 0
url cc-by-3.0 creativecommons,by      creativecommons org licenses by 3 0
url cc-by-sa-3.0 creativecommons,sa   creativecommons org licenses by sa 3 0
url cc-by-nc-3.0 creativecommons,nc   creativecommons org licenses by nc 3 0
url cc-by-nc-sa-3.0 creativecommons,nc creativecommons org licenses by nc sa 3 0
url cc-by-2.0 creativecommons,by      creativecommons org licenses by 2 0
url cc-by-sa-2.0 creativecommons,sa   creativecommons org licenses by sa 2 0
url bsl-1.0 boost,license             boost org license 1 0
url unlicense unlicense,org           unlicense org
url wtfpl wtfpl,net                   wtfpl net
url ofl-1.1 scripts,ofl               scripts sil org ofl
url odbl-1.0 opendatacommons,odbl     opendatacommons org licenses odbl
url pddl-1.0 opendatacommons,pddl     opendatacommons org licenses pddl
url eupl-1.2 joinup,eupl              joinup ec europa eu(?: \S+){0,6} eupl

name gpl-1.0 gnu,general              gnu general public license (?:version |v ?)1(?: 0)?
name gpl-2.0 gnu,general              gnu general public license (?:version |v ?)2(?: 0)?
name gpl-3.0 gnu,general              gnu general public license (?:version |v ?)3(?: 0)?
name gpl-2.0 gnu,general,v2           gnu general public license v2
name gpl-3.0 gnu,general,v3           gnu general public license v3
name gpl-2.0 version,gnu,general      version 2 of the gnu general public license
name gpl-3.0 version,gnu,general      version 3 of the gnu general public license
name gpl-2.0 gpl                      (?:gnu )?gpl (?:version |v )?2(?: 0)?(?= license| licence| only| or|$)
name gpl-3.0 gpl                      (?:gnu )?gpl (?:version |v )?3(?: 0)?(?= license| licence| only| or|$)
name gpl-2.0 gplv2                    (?:gnu )?gplv2
name gpl-3.0 gplv3                    (?:gnu )?gplv3
name lgpl-2.1 lesser,gnu              gnu lesser general public license (?:version |v ?)2 1
name lgpl-3.0 lesser,gnu              gnu lesser general public license (?:version |v ?)3(?: 0)?
name lgpl-2.1 lgplv2                  (?:gnu )?lgplv2 1
name lgpl-3.0 lgplv3                  (?:gnu )?lgplv3
name agpl-3.0 affero,gnu              gnu affero general public license (?:version |v ?)3(?: 0)?
name agpl-3.0 agplv3                  (?:gnu )?agplv3
name apache-1.1 apache,1        apache (?:software )?licen[sc]e (?:version |v )?1 1
name apache-2.0 apache,2        apache (?:software )?licen[sc]e (?:version |v )?2 0
name apache-2.0 apache,v2             apache (?:software )?licen[sc]e v2(?: 0)?
name apache-2.0 apache,2              apache 2 0 licen[sc]e
name bsd-2-clause bsd,clause          (?:bsd (?:2|two) clause|(?:2|two) clause bsd) licen[sc]e
name bsd-3-clause bsd,clause          (?:bsd (?:3|three) clause|(?:3|three) clause bsd) licen[sc]e
name bsd-4-clause bsd,clause          (?:bsd (?:4|four) clause|(?:4|four) clause bsd) licen[sc]e
name bsd-3-clause bsd,new             (?:new|revised|modified) bsd licen[sc]e
name bsd-2-clause bsd,simplified      (?:simplified|freebsd) bsd licen[sc]e
name bsd-4-clause bsd,original        original bsd licen[sc]e
name mpl-1.1 mozilla,public           mozilla public licen[sc]e (?:version |v ?)?1 1
name mpl-2.0 mozilla,public           mozilla public licen[sc]e (?:version |v ?)?2 0
name epl-1.0 eclipse,public           eclipse public licen[sc]e (?:version |v ?)?1 0
name epl-2.0 eclipse,public           eclipse public licen[sc]e (?:version |v ?)?2 0
name cc-by-4.0 cc,by,4                cc by 4 0
name cc-by-3.0 cc,by,3                cc by 3 0
name cc-by-2.5 cc,by,2                cc by 2 5
name cc-by-2.0 cc,by,2                cc by 2 0
name cc-by-sa-4.0 cc,sa,4             cc by sa 4 0
name cc-by-sa-3.0 cc,sa,3             cc by sa 3 0
name cc-by-sa-2.0 cc,sa,2             cc by sa 2 0
name cc-by-nc-4.0 cc,nc,4             cc by nc 4 0
name cc-by-nc-3.0 cc,nc,3             cc by nc 3 0
name cc-by-nd-4.0 cc,nd,4             cc by nd 4 0
name cc-by-nc-sa-4.0 cc,nc,sa         cc by nc sa 4 0
name cc-by-nc-sa-3.0 cc,nc,sa         cc by nc sa 3 0
name cc-by-nc-nd-4.0 cc,nc,nd         cc by nc nd 4 0
name cc0-1.0 cc0                      cc0 1 0(?: universal)?
name artistic-1.0 artistic,1    artistic licen[sc]e (?:version )?1 0
name artistic-2.0 artistic,2    artistic licen[sc]e (?:version )?2 0
name eupl-1.1 european,union          european union public licen[sc]e (?:version |v ?)?1 1
name eupl-1.2 european,union          european union public licen[sc]e (?:version |v ?)?1 2
name ofl-1.1 sil,font                 sil open font licen[sc]e (?:version |v ?)?1 1

mention lgpl lesser,general           (?:gnu )?lesser general public licen[sc]e
mention lgpl library,general          (?:gnu )?library general public licen[sc]e
mention agpl affero,general           (?:gnu )?affero general public licen[sc]e
mention gpl gnu,general               gnu general public licen[sc]e
mention gpl gpl,gnu                   gnu gpl
mention gpl gpl                       gpl licen[sc]ed?
mention lgpl lgpl                     lgpl licen[sc]ed?
mention agpl agpl                     agpl licen[sc]ed?
mention gfdl gnu,documentation        gnu free documentation licen[sc]e
mention apache apache                 apache (?:software )?licen[sc]e
mention mit mit                       mit licen[sc]e
mention mit expat                     expat licen[sc]e
mention isc isc                       isc licen[sc]e
mention bsd bsd                       bsd(?: style)? licen[sc]e
mention mpl mozilla                   mozilla public licen[sc]e
mention epl eclipse                   eclipse public licen[sc]e
mention cpl common                    common public licen[sc]e
mention cddl development              common development and distribution licen[sc]e
mention eupl european                 european union public licen[sc]e
mention cc-by cc,by                   cc by
mention cc-by-sa cc,sa                cc by sa
mention cc-by-nc cc,nc                cc by nc
mention cc-by-nd cc,nd                cc by nd
mention cc-by-nc-sa cc,nc             cc by nc sa
mention cc-by-nc-nd cc,nc             cc by nc nd
mention cc0 cc0                       (?:creative commons (?:zero|cc0)|cc0 (?:licen[sc]e|public domain))
mention cc-by creative,attribution    creative commons attribution(?= licen[sc]e|$)
mention creative-commons creative     creative commons licen[sc]e
mention artistic artistic             artistic licen[sc]e
mention zlib zlib                     zlib(?: libpng)? licen[sc]e
mention bsl-1.0 boost                 boost software licen[sc]e
mention ofl sil                       sil open font licen[sc]e
mention unlicense unlicense           the unlicense
mention postgresql postgresql         postgresql licen[sc]e
mention python psf                    psf licen[sc]e
mention python python                 python software foundation licen[sc]e
mention php php                       php licen[sc]e
mention ruby ruby                     ruby licen[sc]e
mention openssl openssl               openssl licen[sc]e
mention ms-pl microsoft               microsoft public licen[sc]e
mention ms-rl microsoft               microsoft reciprocal licen[sc]e
mention odbl-1.0 odbl                 odbl(?: 1 0| licen[sc]e)
mention odbl-1.0 database             open database licen[sc]e
mention sspl-1.0 sspl                 sspl licen[sc]e
mention sspl-1.0 server               server side public licen[sc]e
mention busl-1.1 business             business source licen[sc]e
mention elastic-2.0 elastic           elastic licen[sc]e
mention upl-1.0 permissive            universal permissive licen[sc]e
mention beerware beer                 beer ?ware licen[sc]e
mention w3c w3c                       w3c (?:software )?licen[sc]e
"""
