"""Hand-written signatures of license notices, headers, grants, conditions and disclaimers.

A rule is (label, keywords, priority, confidence, wording). The keywords, one of which stands in every text the wording fits, gate the rule;
they are single words, as notices are wrapped. In the wording a blank stands for anything between two words (blanks, line ends, comment
marks, quotes, commas) and `…` for up to 1,500 characters of whatever follows; the rest is a regular expression on lower-cased text.

Priorities: 1 sentences several licenses share, 2 single clauses, 3 notices and headers that name their license, 4 whole license bodies,
5 and 6 bodies told from a sibling's by one clause or two. A body holds its clauses, so the clauses give way to it.
"""

from __future__ import annotations

import re

BETWEEN = r"\W{1,24}"
ANYTHING = r"[\s\S]{0,1500}?"

MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this (?:software|work|font software)"
MIT_TERMS = "(?:the|this)? ?(?:above|following) copyright notices? and this permission notice"
BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted"
BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice"
ISC_GRANT = "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
# A body runs on to the end of its disclaimer where that follows.
MIT_END = "(?:…action of contract tort or otherwise)?"
BSD_END = "(?:…procurement of substitute goods or services)?"
ISC_END = "(?:…loss of use data or profits)?"
APACHE_END = "(?:…governing permissions and limitations under the license)?"
GNU_END = "(?:…you should have received a copy of the gnu (?:\\w+ ){1,5}along with this \\w+)?"
GNU_OPTION = "either version {} of the license or at your option any later version"
GNU_TERMS = "you can redistribute it and or modify it under the terms of"

# Public license wordings.
RULES = [
    # MIT and its siblings
    ("mit", "obtaining", 2, 0.9, MIT_GRANT + " and associated documentation files"),
    ("mit", "obtaining", 4, 0.98, MIT_GRANT + "…" + MIT_TERMS + " shall be included in all copies or substantial portions of the software" + MIT_END),
    ("mit", "sublicense", 2, 0.85, "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "furnished", 2, 0.8, "to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "substantial", 2, 0.9, "copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", 2, 0.7, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "tort", 1, 0.6, "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("mit", "mit", 3, 0.9, "use of this source code is governed by an mit style license"),
    ("mit", "mit", 3, 0.9, "(?:this|the) (?:project|software|code|library|package|file|module|work) is (?:under|covered by|available under) (?:the )?mit"),
    ("mit", "mit", 2, 0.8, "license:? mit\\b(?! license)(?!-)"),
    ("mit", "opensource", 2, 0.8, "opensource org licenses mit\\b(?!-)"),
    ("mit-0", "furnished", 5, 0.98, MIT_GRANT + "…is furnished to do so the software is provided as is" + MIT_END),
    ("mit-0", "opensource", 3, 0.9, "opensource org licenses mit 0\\b"),
    ("x11", "consortium", 5, 0.98, MIT_GRANT + "…except as contained in this notice the name of the x consortium shall not be used in advertising" + MIT_END),
    ("x11", "advertising", 2, 0.7, "except as contained in this notice the names? of …shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("json", "evil", 3, 0.95, "the software shall be used for good not evil"),
    ("curl", "stenberg", 3, 0.9, "copyright and permission notice copyright c (?:\\d+ ){1,3}(?:present )?daniel stenberg"),
    ("hpnd", "hereby", 3, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted provided that the above copyright notice appear in all copies"),
    ("hpnd-sell", "hereby", 3, 0.9, "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ntp", "hereby", 3, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies"),
    ("unicode-dfs", "unicode", 3, 0.95, "obtaining a copy of the unicode data files and any associated documentation"),
    ("unicode-3.0", "unicode", 3, 0.95, "unicode license v3"),
    ("bitstream-vera", "accompanying", 3, 0.9, "obtaining a copy of the fonts accompanying this license fonts and associated documentation files"),
    ("postgresql", "hereby", 3, 0.95, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "illinois", 3, 0.95, "to deal with the software without restriction…neither the names of …university of illinois"),
    ("ncsa", "disclaimers", 2, 0.85, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    # ISC family
    ("isc", "hereby", 4, 0.98, ISC_GRANT + " provided that the above copyright notice and this permission notice appear in all copies" + ISC_END),
    ("isc", "disclaim", 2, 0.8, "the software is provided as is and (?:the author|isc|the authors|the copyright holder) disclaims? all warranties with regard to this software"),
    ("isc", "whatsoever", 1, 0.6, "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("isc", "opensource", 2, 0.8, "opensource org licenses isc"),
    ("0bsd", "hereby", 4, 0.95, ISC_GRANT + "(?! provided)" + ISC_END),
    ("0bsd", "opensource", 2, 0.8, "opensource org licenses 0bsd"),
    # BSD family
    ("bsd", "redistribution", 2, 0.8, BSD_GRANT),
    ("bsd-1-clause", "redistributions", 3, 0.85, BSD_GRANT + " provided that the following conditions are met (?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer(?! (?:\\d )?redistributions)"),
    ("bsd-2-clause", "reproduce", 4, 0.95, BSD_GRANT + "…" + BSD_BINARY + " this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution" + BSD_END),
    ("bsd-2-clause", "opensource", 2, 0.8, "opensource org licenses bsd 2 clause"),
    ("bsd-2-clause-views", "freebsd", 3, 0.95, "should not be interpreted as representing official policies either expressed or implied of the freebsd project"),
    ("bsd-2-clause-patent", "patent", 5, 0.9, BSD_GRANT + "…perpetual worldwide non exclusive no charge royalty free irrevocable except for failure to satisfy the conditions of this license patent license" + BSD_END),
    ("bsd-3-clause", "endorse", 5, 0.98, BSD_GRANT + "…neither the names? of …may be used to endorse or promote products derived from this software without specific prior written permission" + BSD_END),
    ("bsd-3-clause", "endorse", 2, 0.85, "neither the names? of [\\s\\S]{0,200}?nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", 5, 0.9, BSD_GRANT + "…the names? of …may not be used to endorse or promote products derived from this software without specific prior written permission" + BSD_END),
    ("bsd-3-clause", "opensource", 2, 0.8, "opensource org licenses bsd 3 clause"),
    ("bsd-3-clause", "bsd", 3, 0.85, "use of this source code is governed by a bsd style license"),
    ("bsd-3-clause-clear", "patent", 3, 0.9, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-no-nuclear", "nuclear", 3, 0.9, "not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("bsd-3-clause-lbnl", "upgrades", 3, 0.9, "you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code"),
    ("bsd-4-clause", "acknowledgement|acknowledgment", 6, 0.98, BSD_GRANT + "…all advertising materials mentioning features or use of this software must display the following acknowledge?ment…neither the name" + BSD_END),
    ("bsd-4-clause", "advertising", 2, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause-uc", "berkeley", 3, 0.9, "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd", "reproduce", 1, 0.7, BSD_BINARY),
    ("bsd", "exemplary", 1, 0.6, "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("bsd", "disclaimed", 1, 0.6, "the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "bsd", 2, 0.8, "license:? (?:new |modified )?bsd\\b(?! license)(?!-)"),
    ("bsd-source-code", "retain", 1, 0.6, "redistributions? of source code must retain the above copyright notice"),
    # Apache
    ("apache-2.0", "apache", 3, 0.98, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license" + APACHE_END),
    ("apache-2.0", "apache", 3, 0.95, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "asf", 3, 0.95, "the asf licenses this file to you under the apache license version 2 0"),
    ("apache-2.0", "apache", 2, 0.9, "apache org licenses license 2 0"),
    ("apache-2.0", "opensource", 2, 0.8, "opensource org licenses apache 2 0"),
    ("apache-2.0", "apache", 4, 0.98, "apache license version 2 0 january 2004…terms and conditions for use reproduction and distribution"),
    ("apache-2.0", "compliance", 1, 0.6, "you may not use this file except in compliance with the license"),
    ("apache-2.0", "governing", 1, 0.6, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "irrevocable", 2, 0.85, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("apache-2.0", "irrevocable", 2, 0.85, "no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work"),
    ("apache-2.0", "prominent", 2, 0.85, "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "notice", 2, 0.85, "if the work includes a notice text file as part of its distribution"),
    ("apache-2.0", "apache", 3, 0.9, "(?:dual )?licensed under (?:the )?(?:mit (?:and|or) )?apache 2 0"),
    ("apache-2.0", "apache", 2, 0.8, "license:? apache 2 0\\b"),
    ("apache-1.1", "apache", 6, 0.95, BSD_GRANT + "…this product includes software developed by the apache software foundation" + BSD_END),
    ("apache-1.0", "apache", 6, 0.95, BSD_GRANT + "…this product includes software developed by the apache group" + BSD_END),
    ("apache-1.1", "acknowledgment", 2, 0.8, "the end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("apache", "apache", 2, 0.8, "products derived from this software may not be called apache"),
    # GNU licenses: file headers
    ("gpl-1.0-or-later", "redistribute", 4, 0.95, GNU_TERMS + " the gnu general public license as published by the free software foundation either version 1 or at your option any later version" + GNU_END),
    ("gpl-2.0-or-later", "redistribute", 4, 0.98, GNU_TERMS + " the gnu general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version" + GNU_END),
    ("gpl-2.0-only", "redistribute", 4, 0.95, GNU_TERMS + " the gnu general public license (?:as published by the free software foundation version 2(?! or)|version 2(?: only)? as published by the free software foundation)" + GNU_END),
    ("gpl-3.0-or-later", "redistribute", 4, 0.98, GNU_TERMS + " the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version" + GNU_END),
    ("gpl-3.0-only", "redistribute", 4, 0.95, GNU_TERMS + " the gnu general public license (?:as published by the free software foundation version 3(?! or)|version 3(?: only)? as published by the free software foundation)" + GNU_END),
    ("lgpl-2.0-or-later", "redistribute", 4, 0.98, GNU_TERMS + " the gnu library general public license as published by the free software foundation " + GNU_OPTION.format("2") + GNU_END),
    ("lgpl-2.1-or-later", "redistribute", 4, 0.98, GNU_TERMS + " the gnu lesser general public license as published by the free software foundation " + GNU_OPTION.format("2 1") + GNU_END),
    ("lgpl-2.1-only", "redistribute", 4, 0.95, GNU_TERMS + " the gnu lesser general public license (?:as published by the free software foundation version 2 1(?! or)|version 2 1(?: only)? as published by the free software foundation)" + GNU_END),
    ("lgpl-3.0-or-later", "redistribute", 4, 0.98, GNU_TERMS + " the gnu lesser general public license as published by the free software foundation " + GNU_OPTION.format("3") + GNU_END),
    ("lgpl-3.0-only", "redistribute", 4, 0.95, GNU_TERMS + " the gnu lesser general public license (?:as published by the free software foundation version 3(?! or)|version 3(?: only)? as published by the free software foundation)" + GNU_END),
    ("agpl-3.0-or-later", "affero", 4, 0.98, GNU_TERMS + " the gnu affero general public license as published by the free software foundation " + GNU_OPTION.format("3") + GNU_END),
    ("agpl-3.0-only", "affero", 4, 0.95, GNU_TERMS + " the gnu affero general public license (?:as published by the free software foundation version 3(?! or)|version 3(?: only)? as published by the free software foundation)" + GNU_END),
    ("gpl", "merchantability", 2, 0.75, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "merchantability", 2, 0.75, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license for more details"),
    ("agpl-3.0", "merchantability", 2, 0.75, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("gpl", "gnu", 2, 0.8, "you should have received a copy of the gnu general public license along with this (?:program|software|library|package|file)"),
    ("lgpl", "gnu", 2, 0.8, "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|library|package|file)"),
    ("agpl-3.0", "affero", 2, 0.8, "you should have received a copy of the gnu affero general public license along with this (?:program|software|library|package|file)"),
    # GNU licenses: bodies and addresses
    ("gpl-2.0", "gnu", 4, 0.98, "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu", 4, 0.98, "gnu general public license version 3 29 june 2007"),
    ("gpl-1.0", "gnu", 4, 0.98, "gnu general public license version 1 february 1989"),
    ("lgpl-2.0", "gnu", 4, 0.98, "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "gnu", 4, 0.98, "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu", 4, 0.98, "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", "gnu", 4, 0.98, "gnu affero general public license version 3 19 november 2007"),
    ("gfdl", "gnu", 4, 0.98, "gnu free documentation license version 1 [123] (?:march 2000|november 2002|3 november 2008)"),
    ("gfdl", "gnu", 4, 0.95, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", 2, 0.85, "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-2.0", "verbatim", 2, 0.8, "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2.0", "freedom", 2, 0.8, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", 2, 0.8, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "verbatim", 2, 0.8, "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-3.0", "propagate", 2, 0.8, "you may make run and propagate covered works that you do not convey without conditions"),
    ("lgpl-2.1", "library", 2, 0.8, "a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("lgpl-3.0", "supplemented", 2, 0.85, "incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions"),
    ("agpl-3.0", "remotely", 2, 0.85, "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gpl-2.0", "gnu", 2, 0.8, "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", 2, 0.8, "gnu org licenses gpl 3 0"),
    ("gpl", "gnu", 2, 0.75, "gnu org licenses gpl\\b(?! \\d)"),
    ("lgpl-2.1", "gnu", 2, 0.8, "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", 2, 0.8, "gnu org licenses lgpl 3 0"),
    ("lgpl", "gnu", 2, 0.75, "gnu org licenses lgpl\\b(?! \\d)"),
    ("agpl-3.0", "gnu", 2, 0.8, "gnu org licenses agpl(?: 3 0)?\\b"),
    ("gfdl", "gnu", 2, 0.8, "gnu org (?:licenses|copyleft) fdl\\b"),
    ("gpl-2.0-only", "gpl", 3, 0.9, "(?:gplv2|gpl v?2(?: 0)?) only"),
    ("gpl-2.0-or-later", "gpl", 3, 0.9, "(?:gplv2\\+|gpl v?2(?: 0)? or (?:any )?later)"),
    ("gpl-3.0-or-later", "gpl", 3, 0.9, "(?:gplv3\\+|gpl v?3(?: 0)? or (?:any )?later)"),
    ("gpl-3.0-only", "gpl", 3, 0.9, "(?:gplv3|gpl v?3(?: 0)?) only"),
    ("lgpl-2.1-or-later", "lgpl", 3, 0.9, "lgpl v?2 1 or (?:any )?later"),
    ("classpath-exception", "linking", 3, 0.95, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("classpath-exception", "classpath", 3, 0.9, "(?:gnu )?classpath exception"),
    ("gcc-exception", "gcc", 3, 0.95, "gcc runtime library exception"),
    ("bison-exception", "bison", 3, 0.95, "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "autoconf", 3, 0.95, "as a special exception …configure scripts? generated by autoconf"),
    ("font-exception", "font", 3, 0.9, "if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("linux-syscall-note", "kernel", 3, 0.95, "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("openssl-exception", "openssl", 3, 0.9, "permission to link the code of portions of this program with the openssl library"),
    ("llvm-exception", "llvm", 3, 0.95, "(?:apache 2 0|apache license v2 0) with llvm exceptions?"),
    # Weak copyleft
    ("mpl-2.0", "mozilla", 4, 0.98, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla", 4, 0.95, "if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0"),
    ("mpl-2.0", "incompatible", 3, 0.9, "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-2.0", "mpl", 2, 0.8, "mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla", 4, 0.98, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", 4, 0.95, "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-1.1", "mpl", 2, 0.8, "mozilla org mpl (?:mpl )?1 1"),
    ("npl-1.1", "netscape", 4, 0.95, "the contents of this file are subject to the netscape public license version 1 1"),
    ("mpl-1.1-gpl-2.0-lgpl-2.1", "alternatively", 3, 0.9, "alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later"),
    ("epl-1.0", "eclipse", 4, 0.95, "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)?(?: |)1 0"),
    ("epl-2.0", "eclipse", 4, 0.95, "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)?(?: |))?2 0"),
    ("epl-1.0", "eclipse", 2, 0.8, "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", 2, 0.8, "eclipse org legal epl (?:2 0|v20)"),
    ("epl-2.0", "secondary", 3, 0.85, "this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license"),
    ("cpl-1.0", "common", 3, 0.9, "common public license(?: version| v)?(?: |)1 0"),
    ("ipl-1.0", "ibm", 3, 0.9, "ibm public license(?: version| v)?(?: |)1 0"),
    ("cddl-1.0", "distribution", 3, 0.9, "common development and distribution license (?:cddl )?(?:version )?1 0"),
    ("cddl-1.0", "cddl", 4, 0.95, "the contents of this file are subject to the terms of the common development and distribution license …cddl header"),
    ("cddl-1.0", "cddl", 2, 0.8, "opensource org licenses cddl"),
    ("eupl-1.2", "eupl", 4, 0.95, "licensed under the eupl version 1 2 or as soon they will be approved by the european commission"),
    ("eupl-1.1", "eupl", 4, 0.95, "licensed under the eupl version 1 1 or as soon they will be approved by the european commission"),
    ("eupl-1.2", "eupl", 3, 0.9, "licensed under the eupl(?: 1 2| v 1 2| or)"),
    ("osl-3.0", "academic|open", 3, 0.9, "licensed under the open software license version 3 0"),
    ("afl-3.0", "academic", 3, 0.9, "licensed under the academic free license version 3 0"),
    ("afl-2.1", "academic", 3, 0.9, "licensed under the academic free license version 2 1"),
    ("ms-pl", "microsoft", 4, 0.95, "this license governs use of the accompanying software if you use the software you accept this license…microsoft public license"),
    ("ms-pl", "accompanying", 2, 0.8, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "recipients", 2, 0.85, "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code"),
    ("cecill-2.1", "cecill", 3, 0.9, "cecill (?:free software license agreement|license under french law|license)"),
    ("cecill-b", "cecill", 3, 0.9, "cecill b (?:free software license agreement|license under french law|license)"),
    ("cecill-c", "cecill", 3, 0.9, "cecill c (?:free software license agreement|license under french law|license)"),
    ("artistic-1.0", "package", 3, 0.85, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "artistic", 4, 0.95, "the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("artistic-perl", "perl", 3, 0.95, "you can redistribute it and or modify it under the same terms as perl(?: 5)? itself"),
    # Permissive others
    ("zlib", "misrepresented", 4, 0.98, "this software is provided as is without any express or implied warranty…the origin of this software must not be misrepresented…this notice may not be removed or altered from any source distribution"),
    ("zlib", "misrepresented", 2, 0.9, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 2, 0.85, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "freely", 2, 0.8, "to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", "png", 3, 0.9, "png reference library (?:license )?version 2"),
    ("libpng", "libpng", 3, 0.85, "this code is released under the libpng license"),
    ("bsl-1.0", "boost", 4, 0.98, "distributed under the boost software license version 1 0 see accompanying file license_1_0 txt"),
    ("bsl-1.0", "boost", 2, 0.85, "boost org license_1_0 txt"),
    ("bsl-1.0", "machine", 2, 0.85, "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("bsl-1.0", "organization", 4, 0.95, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unencumbered", 4, 0.98, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", 2, 0.9, "unlicense org"),
    ("unlicense", "detriment", 2, 0.85, "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", "fuck", 4, 0.95, "do what the fuck you want to(?: public license)?"),
    ("wtfpl", "wtfpl", 2, 0.8, "wtfpl net"),
    ("beerware", "whatever", 4, 0.95, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", "beer", 3, 0.9, "beer ?ware license"),
    ("psf-2.0", "python", 4, 0.95, "this license agreement is between the python software foundation psf and the individual or organization"),
    ("python-2.0", "python", 3, 0.85, "python software foundation license version 2"),
    ("cnri-python", "initiatives", 3, 0.9, "this license agreement is between the corporation for national research initiatives"),
    ("ofl-1.1", "sil", 4, 0.98, "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "sil", 2, 0.85, "scripts sil org ofl"),
    ("ofl-1.1", "reserved", 2, 0.85, "no modified version of the font software may use the reserved font name"),
    ("ofl-1.1", "font", 2, 0.85, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("openssl", "openssl", 3, 0.95, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", 3, 0.95, "this product includes cryptographic software written by eric young"),
    ("php-3.01", "php", 4, 0.95, "this source file is subject to version 3 01 of the php license"),
    ("php-3.0", "php", 4, 0.95, "this source file is subject to version 3 0 of the php license"),
    ("php-3.01", "php", 3, 0.9, "products derived from this software may not be called php nor may php appear in their name"),
    ("zend-2.0", "zend", 3, 0.95, "this source file is subject to version 2 00 of the zend license"),
    ("ruby", "redistribute", 3, 0.9, "you may redistribute it and or modify it under (?:either )?(?:the terms of the (?:2 clause bsdl|gpl)|the same terms as ruby)"),
    ("vim", "vim", 3, 0.9, "vim is charityware you can use and copy it as much as you like"),
    ("tcl", "documentation", 3, 0.9, "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("w3c", "w3c", 4, 0.95, "w3c software (?:and document )?notice and license"),
    ("w3c", "licensee", 3, 0.9, "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("ijg", "jpeg", 3, 0.95, "this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", 3, 0.95, "portions of this software are copyright …the freetype project"),
    ("icu", "icu", 3, 0.85, "icu license icu 1 8 1 and later"),
    ("sqlite-blessing", "forgiveness", 4, 0.95, "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("upl-1.0", "universal", 3, 0.9, "(?:the )?universal permissive license(?: upl)?(?: version| v)?(?: |)1 0"),
    ("ecl-2.0", "educational", 3, 0.9, "licensed under the educational community license version 2 0"),
    ("blueoak-1.0.0", "blue", 3, 0.95, "blue oak model license"),
    ("mulan-psl-2.0", "mulan", 3, 0.95, "licensed under (?:the )?mulan psl v2"),
    ("bzip2-1.0.6", "bzip2", 3, 0.9, "this program bzip2 the associated library libbzip2 and all documentation"),
    ("info-zip", "zip", 3, 0.95, "this is version (?:\\w+ ){1,8}of the info zip (?:copyright and )?license"),
    ("fair", "usage", 3, 0.85, "usage of the works is permitted provided that this instrument is retained with the works"),
    ("wxwindows", "wxwindows", 3, 0.95, "wxwindows library licen[cs]e"),
    # Creative Commons and data
    ("cc0-1.0", "waived", 4, 0.95, "to the extent possible under law …has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "creativecommons", 3, 0.95, "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons", 3, 0.95, "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", 3, 0.95, "creativecommons org licenses by [1-4] \\d"),
    ("cc-by-sa", "creativecommons", 3, 0.95, "creativecommons org licenses by sa [1-4] \\d"),
    ("cc-by-nd", "creativecommons", 3, 0.95, "creativecommons org licenses by nd [1-4] \\d"),
    ("cc-by-nc", "creativecommons", 3, 0.95, "creativecommons org licenses by nc [1-4] \\d"),
    ("cc-by-nc-sa", "creativecommons", 3, 0.95, "creativecommons org licenses by nc sa [1-4] \\d"),
    ("cc-by-nc-nd", "creativecommons", 3, 0.95, "creativecommons org licenses by nc nd [1-4] \\d"),
    ("cc-by", "creative", 4, 0.95, "licensed under (?:a|the) creative commons attribution (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    ("cc-by-sa", "creative", 4, 0.95, "licensed under (?:a|the) creative commons attribution share ?alike (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    ("cc-by-nc", "creative", 4, 0.95, "licensed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    ("cc-by-nd", "creative", 4, 0.95, "licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    ("cc-by-nc-sa", "creative", 4, 0.95, "licensed under (?:a|the) creative commons attribution non ?commercial share ?alike (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    ("cc-by-nc-nd", "creative", 4, 0.95, "licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    ("cc-by", "creative", 1, 0.6, "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("odbl-1.0", "opendatacommons", 3, 0.95, "opendatacommons org licenses odbl"),
    ("odbl-1.0", "database", 4, 0.95, "made available under the open database license"),
    ("odc-by-1.0", "opendatacommons", 3, 0.95, "opendatacommons org licenses by"),
    ("pddl-1.0", "opendatacommons", 3, 0.95, "opendatacommons org licenses pddl"),
    ("dbcl-1.0", "opendatacommons", 3, 0.95, "opendatacommons org licenses dbcl"),
    ("ogl-uk-3.0", "government", 3, 0.9, "(?:licensed under the )?open government licen[cs]e v(?:ersion )?3 0"),
    ("etalab-2.0", "licence|license|etalab", 3, 0.9, "(?:etalab )?(?:licence ouverte|open licen[cs]e) 2 0"),
    # Source-available and closed terms
    ("sspl-1.0", "server", 3, 0.95, "server side public license(?: version| v)?(?: |)1"),
    ("busl-1.1", "business", 3, 0.95, "business source license 1 1"),
    ("elastic-2.0", "elastic", 3, 0.95, "elastic license(?: version)? 2 0"),
    ("commons-clause", "grant", 3, 0.95, "the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial-1.0.0", "polyform", 3, 0.95, "polyform noncommercial license"),
    ("openrail", "rail", 3, 0.9, "(?:bigscience |creativeml )?open ?rail m? ?license"),
    ("llama-community", "llama", 3, 0.9, "llama \\d (?:\\d )?community license agreement"),
    ("proprietary", "confidential", 3, 0.9, "this (?:software|document|file|material) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized", 3, 0.9, "unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("proprietary", "reproduced", 3, 0.85, "no part of this (?:publication|book|work|document) may be reproduced (?:stored|distributed|transmitted|in any form)"),
    ("proprietary", "permission", 2, 0.8, "all rights reserved …without (?:the )?(?:express |prior )*written permission"),
    ("us-government-work", "government", 3, 0.9, "this (?:software|work|document) (?:was|is) (?:prepared|a work|created) …(?:united states|u s) government …not subject to copyright"),
    ("public-domain", "domain", 3, 0.9, "(?:this|the) (?:file|software|code|work|document|program|text) (?:is|has been|was) (?:hereby )?(?:placed |released |put )?(?:in|into|to) the public domain"),
    ("public-domain", "disclaim", 3, 0.9, "the authors? (?:hereby )?disclaims? copyright to this source code"),
]

#: Stands right before many notices and says nothing of its own there.
RESERVED = re.compile(rf"all rights reserved{BETWEEN}$")
RESERVED_SPAN = len("all rights reserved") + 24


def compiled(wording: str) -> re.Pattern:
    return re.compile(wording.replace(" ?", r"\W{0,24}").replace(" ", BETWEEN).replace("…", ANYTHING))
