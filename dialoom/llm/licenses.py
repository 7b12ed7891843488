"""License detection by ordered signature rules.

The rules are hand-written regular expressions, in order of priority: tags, links, sentences of the
licenses' texts, statements of grant, names with a version, names. They are matched in the text in lower
case with single spaces. Each has a keyword that every text with a match contains; a text is searched
for the keywords first, and only the rules whose keyword it has are run. Overlapping detections are resolved by priority:
a detection that lies inside one of higher priority (or of the same priority and greater length, or
earlier) is suppressed. Three base phrases are found by words and always stay.

Defined cases: a null text counts as empty; an empty text has no words and no labels; each row is
judged on its own; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value

ship_by_value(__name__)

#: Base phrases: words, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, keyword (or several, parted by ~), pattern, priority; the label of a tag is what it names.
SIGNATURES = r"""
# Tags.
{tag}|spdx-license-identifier|spdx-license-identifier: *(?:\( *)?([a-z0-9.+-]+)|0
# Links to a license's page.
apache-2.0|apache.org/licenses|apache\.org/licenses/license-2\.0|1
apache-1.1|apache.org/licenses|apache\.org/licenses/license-1\.1|1
apache|apache.org/licenses|apache\.org/licenses/?(?!license)|1
mit|opensource.org/licenses|opensource\.org/licenses/mit\b|1
bsd-2-clause|opensource.org/licenses|opensource\.org/licenses/bsd-2-clause|1
bsd-3-clause|opensource.org/licenses|opensource\.org/licenses/bsd-3-clause|1
isc|opensource.org/licenses|opensource\.org/licenses/isc\b|1
artistic-2.0|opensource.org/licenses|opensource\.org/licenses/artistic-2\.0|1
zlib|opensource.org/licenses|opensource\.org/licenses/zlib|1
gpl-3.0|gnu.org/licenses|gnu\.org/licenses/gpl-3\.0|1
gpl-2.0|gnu.org/licenses|gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0|1
lgpl-3.0|gnu.org/licenses|gnu\.org/licenses/lgpl-3\.0|1
lgpl-2.1|gnu.org/licenses|gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1|1
agpl-3.0|gnu.org/licenses|gnu\.org/licenses/agpl-3\.0|1
gfdl-1.3|gnu.org/licenses|gnu\.org/licenses/fdl-1\.3|1
gpl|gnu.org/licenses|gnu\.org/licenses/gpl\b(?!-)|1
gpl|gnu.org/copyleft|gnu\.org/copyleft/gpl|1
mpl-2.0|mozilla.org|mozilla\.org/(?:en-us/)?mpl/2\.0|1
mpl-1.1|mozilla.org/mpl|mozilla\.org/mpl/(?:mpl-)?1\.1|1
epl-2.0|eclipse.org/legal|eclipse\.org/legal/epl-2\.0|1
epl-1.0|eclipse.org/legal|eclipse\.org/legal/epl-v10|1
unlicense|unlicense.org|unlicense\.org|1
wtfpl|wtfpl.net|wtfpl\.net|1
bsl-1.0|boost.org/license|boost\.org/license_1_0|1
ofl-1.1|scripts.sil.org/ofl|scripts\.sil\.org/ofl|1
cc0-1.0|creativecommons.org|creativecommons\.org/publicdomain/zero/1\.0|1
public-domain|creativecommons.org|creativecommons\.org/publicdomain/mark/1\.0|1
cc-by-4.0|creativecommons.org|creativecommons\.org/licenses/by/4\.0|1
cc-by-3.0|creativecommons.org|creativecommons\.org/licenses/by/3\.0|1
cc-by-2.5|creativecommons.org|creativecommons\.org/licenses/by/2\.5|1
cc-by-2.0|creativecommons.org|creativecommons\.org/licenses/by/2\.0|1
cc-by-sa-4.0|creativecommons.org|creativecommons\.org/licenses/by-sa/4\.0|1
cc-by-sa-3.0|creativecommons.org|creativecommons\.org/licenses/by-sa/3\.0|1
cc-by-sa-2.5|creativecommons.org|creativecommons\.org/licenses/by-sa/2\.5|1
cc-by-nc-4.0|creativecommons.org|creativecommons\.org/licenses/by-nc/4\.0|1
cc-by-nc-3.0|creativecommons.org|creativecommons\.org/licenses/by-nc/3\.0|1
cc-by-nd-4.0|creativecommons.org|creativecommons\.org/licenses/by-nd/4\.0|1
cc-by-nd-3.0|creativecommons.org|creativecommons\.org/licenses/by-nd/3\.0|1
cc-by-nc-sa-4.0|creativecommons.org|creativecommons\.org/licenses/by-nc-sa/4\.0|1
cc-by-nc-sa-3.0|creativecommons.org|creativecommons\.org/licenses/by-nc-sa/3\.0|1
cc-by-nc-nd-4.0|creativecommons.org|creativecommons\.org/licenses/by-nc-nd/4\.0|1
cc-by-nc-nd-3.0|creativecommons.org|creativecommons\.org/licenses/by-nc-nd/3\.0|1
odbl-1.0|opendatacommons.org|opendatacommons\.org/licenses/odbl|1
odc-by-1.0|opendatacommons.org|opendatacommons\.org/licenses/by\b|1
pddl-1.0|opendatacommons.org|opendatacommons\.org/licenses/pddl|1
# Sentences of the licenses' texts.
mit|permission is hereby granted|permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files|2
mit|without restriction, including|without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense|2
mit|permission notice shall be included|the above copyright notice and this permission notice shall be included in all copies or substantial portions|2
mit|authors or copyright holders|in no event shall the authors or copyright holders be liable for any claim|2
isc|permission to use, copy, modify|permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted|2
isc|the author disclaims all warranties|the author disclaims all warranties with regard to this software|2
0bsd|permission to use, copy, modify|permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.(?! *provided)|2
hpnd|permission to use, copy, modify|permission to use, copy, modify,? and distribute this software and its documentation for any purpose|2
bsd|redistribution and use in source|redistribution and use in source and binary forms, with or without modification, are permitted|2
bsd|redistributions of source code must|redistributions of source code must retain the above copyright notice|2
bsd|redistributions in binary form must|redistributions in binary form must reproduce the above copyright notice|2
bsd-3-clause|may be used to endorse|neither the names? of .{1,120}? nor the names of its contributors may be used to endorse or promote products|2
bsd-4-clause|advertising materials mentioning|all advertising materials mentioning features or use of this software must display|2
bsd|and contributors|this software is provided by the (?:copyright holders|regents) and contributors ["']{0,2}as is|2
apache-2.0|apache license|licensed under the apache license, version 2\.0 \(the ["']license["']\)|2
apache-2.0|except in compliance with the license|you may not use this file except in compliance with the license|2
apache-2.0|distributed on an|software distributed under the license is distributed on an ["']as is["'] basis|2
apache-2.0|contributor hereby grants|each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free|2
apache-2.0|derivative works a copy of this license|you must give any other recipients of the work or derivative works a copy of this license|2
gpl|redistribute it and/or modify|redistribute it and/or modify it under the terms of the gnu general public license|2
lgpl|redistribute it and/or modify|redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license|2
agpl|redistribute it and/or modify|redistribute it and/or modify it under the terms of the gnu affero general public license|2
gpl-2.0-or-later|or (at your option) any later version|version 2(?: of the license)?,? or \(at your option\) any later version|2
gpl-3.0-or-later|or (at your option) any later version|version 3(?: of the license)?,? or \(at your option\) any later version|2
gpl|useful, but without any warranty|in the hope that it will be useful, but without any warranty|2
gpl|you should have received|you should have received a copy of the gnu general public license along with|2
lgpl|you should have received|you should have received a copy of the gnu lesser general public license along with|2
gpl|most software are designed|the licenses for most software are designed to take away your freedom|2
gpl|copyleft license for software|the gnu general public license is a free, copyleft license for software|2
agpl|interacting with it|all users interacting with it remotely through a computer network|2
lgpl|the additional permissions|incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions|2
gfdl|gnu free documentation|permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license|2
mpl-2.0|subject to the terms of the mozilla|this source code form is subject to the terms of the mozilla public license, v\. 2\.0|2
mpl-1.1|subject to the mozilla|the contents of this file are subject to the mozilla public license version 1\.1|2
mpl-2.0|incompatible with secondary|this source code form is ["']incompatible with secondary licenses["']|2
epl|eclipse public|the accompanying program is provided under the terms of this eclipse public license|2
epl-2.0|accompanying materials|this program and the accompanying materials are made available under the terms of the eclipse public license(?: v(?:ersion)?)? ?2\.0|2
epl-1.0|accompanying materials|this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0|2
cddl|common development and distribution|the contents of this file are subject to the terms of the common development and distribution license|2
cpl|accompanying program is provided|the accompanying program is provided under the terms of this common public license|2
bsl-1.0|obtaining a copy of the software and|permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license|2
zlib|altered source versions|altered source versions must be plainly marked as such|2
zlib|provided 'as-is'|this software is provided 'as-is', without any express or implied warranty|2
zlib|origin of this software|the origin of this software must not be misrepresented|2
unlicense|released into the public domain|this is free and unencumbered software released into the public domain|2
unlicense|free to copy, modify, publish|anyone is free to copy, modify, publish, use, compile, sell, or distribute this software|2
wtfpl|do what the f|you just do what the f[*u]ck you want to|2
wtfpl|do what the f|do what the f[*u]ck you want to public licen[cs]e|2
cc0-1.0|dedicated the work|the person who associated a work with this deed has dedicated the work to the public domain by waiving|2
cc0-1.0|affirmer|affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives|2
cc-by|you are free to|you are free to:? share .{1,60}? copy and redistribute the material in any medium or format|2
cc-by|appropriate credit|you must give appropriate credit, provide a link to the license, and indicate if changes were made|2
cc-by-sa|under the same license|you must distribute your contributions under the same license as the original|2
cc-by-nc|for commercial purposes|you may not use the material for commercial purposes|2
cc-by-nd|modified material|you may not distribute the modified material|2
ofl-1.1|reserved font name|with reserved font names?\b|2
ofl-1.1|font software|the font software may be sold as part of a larger software package|2
artistic|the intent of this document|the intent of this document is to state the conditions under which a package may be copied|2
artistic-2.0|standard version|you are permitted to use the standard version and create and use modified versions for any purpose without restriction|2
psf-2.0|psf is making|psf is making python available to licensee on an ["']as is["'] basis|2
openssl|openssl|this product includes software developed by the openssl project|2
ms-pl|is the original software|a ["']contribution["'] is the original software, or any additions or changes to the software|2
json|good, not evil|the software shall be used for good, not evil|2
beerware|buy me a beer|you can buy me a beer in return|2
busl-1.1|change license|on the change date, .{1,200}? under the terms of the change license|2
sspl-1.0|service source code|you must make the service source code available via network download to everyone|2
elastic-2.0|hosted or managed service|you may not provide the software to third parties as a hosted or managed service|2
commons-clause|the right to sell|the grant of rights under the license will not include .{1,60}? the right to sell the software|2
odbl-1.0|open database|made available under the open database license|2
pddl|public domain dedication and|made available under the public domain dedication and license|2
eupl|eupl|licensed under the eupl|2
proprietary|proprietary and confidential|(?:is|are) (?:strictly )?proprietary and confidential|2
proprietary|unauthorized copying|unauthorized copying of this (?:file|software|document), via any medium,? is strictly prohibited|2
proprietary|trade secret|contains (?:confidential information and )?trade secrets?\b|2
proprietary|may be reproduced|no part of this (?:publication|document|book|work) may be reproduced|2
proprietary|prior written permission|without the (?:express )?prior written permission of the (?:publisher|copyright (?:owner|holder)|author)|2
proprietary|for internal use only|for internal use only|2
proprietary|user licen|end[- ]user licen[cs]e agreement|2
evaluation|evaluation purposes|for evaluation purposes only|2
non-commercial|commercial use only|for (?:personal,? )?non-?commercial use only|2
academic|academic|for academic (?:and research )?(?:use|purposes) only|2
warranty|without warranty of any kind|without warranty of any kind|3
warranty|merchantability|warranties of merchantability(?: and|,) fitness for a particular purpose|3
warranty|liable for any|in no event shall .{1,80}? be liable for any (?:direct|indirect|special|incidental)|3
# Statements of grant.
apache-2.0|apache|(?:licen[cs]ed|released|distributed|available) under the (?:terms of the )?apache(?: software)? licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?\b|3
apache|apache|(?:licen[cs]ed|released|distributed|available) under the (?:terms of the )?apache(?: software)? licen[cs]e|3
mit|mit licen|(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |an )?mit licen[cs]e|3
mit|under mit|(?:licen[cs]ed|released) under mit\b|3
bsd|bsd licen|(?:licen[cs]ed|released|distributed|available) under the (?:terms of the )?bsd licen[cs]e|3
bsd|bsd-style|under a bsd-style licen[cs]e|3
gpl|under the gpl|(?:licen[cs]ed|released|distributed|available) under the gpl\b|3
gpl-2.0|under the gpl|(?:licen[cs]ed|released|distributed|available) under the gpl ?v?2|3
gpl-3.0|under the gpl|(?:licen[cs]ed|released|distributed|available) under the gpl ?v?3|3
gpl|gnu|(?:licen[cs]ed|released|distributed|available) under the (?:terms of the )?gnu (?:gpl|general public licen[cs]e)|3
lgpl|under the lgpl|(?:licen[cs]ed|released|distributed|available) under the lgpl|3
agpl|under the agpl|(?:licen[cs]ed|released|distributed|available) under the agpl|3
mpl|under the mpl|(?:licen[cs]ed|released|distributed|available) under the mpl|3
isc|under the isc|(?:licen[cs]ed|released|distributed|available) under the isc licen[cs]e|3
cc0|cc0|(?:licen[cs]ed|released|distributed|available) under (?:the )?cc0|3
cc-by|cc by~cc-by|(?:licen[cs]ed|released|distributed|available|shared) under (?:the )?cc[- ]by(?![- ](?:sa|nc|nd))|3
cc-by-sa|cc by~cc-by|(?:licen[cs]ed|released|distributed|available|shared) under (?:the )?cc[- ]by[- ]sa|3
cc-by-nc|cc by~cc-by|(?:licen[cs]ed|released|distributed|available|shared) under (?:the )?cc[- ]by[- ]nc(?![- ](?:sa|nd))|3
cc|creative commons|under (?:a|the) creative commons(?: \w+){0,5} licen[cs]e|3
public-domain|public domain|(?:is|are|been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain|3
public-domain|public domain|this (?:work|text|file|book|document|code|material) is (?:in|part of) the public domain|3
ogl|open government|under the open government licen[cs]e|3
dual|dual|dual[- ]licen[cs]ed|3
copyright|copyright (c)|copyright \(c\) ?\d{4}|3
copyright|copyright ©|copyright © ?\d{4}|3
copyright|copyright 19|copyright 19\d\d\b|3
copyright|copyright 20|copyright 20\d\d\b|3
copyright|©|© ?\d{4}\b|3
reserved|rights reserved|\b(?:all|some|no) rights reserved\b|3
# Names with a version.
apache-2.0|apache|\bapache(?: software)? licen[cs]e,? ?\(?(?:version |v\.? ?)?2\.0\b|4
apache-2.0|apache-2.0|\bapache-2\.0\b|4
apache-1.1|apache|\bapache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?1\.1\b|4
apache-1.0|apache|\bapache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?1\.0\b|4
gpl-1.0|general public|\bgeneral public licen[cs]e,? ?(?:version |v\.? ?)1\b|4
gpl-2.0|general public|(?<!lesser )(?<!affero )(?<!library )\bgeneral public licen[cs]e,? ?(?:version |v\.? ?)2\b|4
gpl-3.0|general public|(?<!lesser )(?<!affero )\bgeneral public licen[cs]e,? ?(?:version |v\.? ?)3\b|4
lgpl-2.0|library general public|\blibrary general public licen[cs]e,? ?(?:version |v\.? ?)2\b|4
lgpl-2.1|lesser general public|\blesser general public licen[cs]e,? ?(?:version |v\.? ?)2\.1|4
lgpl-3.0|lesser general public|\blesser general public licen[cs]e,? ?(?:version |v\.? ?)3\b|4
agpl-3.0|affero general public|\baffero general public licen[cs]e,? ?(?:version |v\.? ?)3\b|4
gpl-2.0|gpl|\bgpl[- ]?(?:version |v\.? ?)?2(?:\.0)?\b|4
gpl-3.0|gpl|\bgpl[- ]?(?:version |v\.? ?)?3(?:\.0)?\b|4
lgpl-2.1|lgpl|\blgpl[- ]?(?:version |v\.? ?)?2\.1\b|4
lgpl-3.0|lgpl|\blgpl[- ]?(?:version |v\.? ?)?3(?:\.0)?\b|4
agpl-3.0|agpl|\bagpl[- ]?(?:version |v\.? ?)?3(?:\.0)?\b|4
mpl-1.0|mozilla public|\bmozilla public licen[cs]e,? ?(?:version |v\.? ?)?1\.0\b|4
mpl-1.1|mozilla public|\bmozilla public licen[cs]e,? ?(?:version |v\.? ?)?1\.1\b|4
mpl-2.0|mozilla public|\bmozilla public licen[cs]e,? ?(?:version |v\.? ?)?2\.0\b|4
mpl-2.0|mpl|\bmpl[- ]?(?:version |v\.? ?)?2\.0\b|4
epl-1.0|eclipse public|\beclipse public licen[cs]e,? ?(?:-? ?v(?:ersion)?\.? ?)?1\.0\b|4
epl-2.0|eclipse public|\beclipse public licen[cs]e,? ?(?:-? ?v(?:ersion)?\.? ?)?2\.0\b|4
edl-1.0|eclipse distribution|\beclipse distribution licen[cs]e,? ?(?:-? ?v(?:ersion)?\.? ?)?1\.0\b|4
cddl-1.0|cddl|\bcddl[- ]?(?:version |v\.? ?)?1\.0\b|4
cddl-1.1|cddl|\bcddl[- ]?(?:version |v\.? ?)?1\.1\b|4
eupl-1.1|eupl|\beupl[- ]?(?:version |v\.? ?)?1\.1\b|4
eupl-1.2|eupl|\beupl[- ]?(?:version |v\.? ?)?1\.2\b|4
artistic-1.0|artistic licen|\bartistic licen[cs]e,? ?(?:version |v\.? ?)?1\.0\b|4
artistic-2.0|artistic licen|\bartistic licen[cs]e,? ?(?:version |v\.? ?)?2\.0\b|4
bsl-1.0|boost software|\bboost software licen[cs]e(?: -)?,? ?(?:version |v\.? ?)?1\.0\b|4
ofl-1.1|open font licen|\bopen font licen[cs]e,? ?(?:version |v\.? ?)?1\.1\b|4
osl-3.0|open software licen|\bopen software licen[cs]e,? ?(?:version |v\.? ?)?3\.0\b|4
afl-3.0|academic free|\bacademic free licen[cs]e,? ?(?:version |v\.? ?)?3\.0\b|4
busl-1.1|business source|\bbusiness source licen[cs]e,? ?(?:version |v\.? ?)?1\.1\b|4
gfdl-1.2|free documentation|\bfree documentation licen[cs]e,? ?(?:version |v\.? ?)?1\.2\b|4
gfdl-1.3|free documentation|\bfree documentation licen[cs]e,? ?(?:version |v\.? ?)?1\.3\b|4
cc0-1.0|cc0|\bcc0[- ]1\.0\b|4
cc-by-1.0|cc by~cc-by|\bcc[- ]by[- ]1\.0\b|4
cc-by-2.0|cc by~cc-by|\bcc[- ]by[- ]2\.0\b|4
cc-by-2.5|cc by~cc-by|\bcc[- ]by[- ]2\.5\b|4
cc-by-3.0|cc by~cc-by|\bcc[- ]by[- ]3\.0\b|4
cc-by-4.0|cc by~cc-by|\bcc[- ]by[- ]4\.0\b|4
cc-by-sa-2.0|by-sa|\bcc[- ]by-sa[- ]2\.0\b|4
cc-by-sa-2.5|by-sa|\bcc[- ]by-sa[- ]2\.5\b|4
cc-by-sa-3.0|by-sa|\bcc[- ]by-sa[- ]3\.0\b|4
cc-by-sa-4.0|by-sa|\bcc[- ]by-sa[- ]4\.0\b|4
cc-by-nc-3.0|by-nc|\bcc[- ]by-nc[- ]3\.0\b|4
cc-by-nc-4.0|by-nc|\bcc[- ]by-nc[- ]4\.0\b|4
cc-by-nd-3.0|by-nd|\bcc[- ]by-nd[- ]3\.0\b|4
cc-by-nd-4.0|by-nd|\bcc[- ]by-nd[- ]4\.0\b|4
cc-by-nc-sa-3.0|by-nc-sa|\bcc[- ]by-nc-sa[- ]3\.0\b|4
cc-by-nc-sa-4.0|by-nc-sa|\bcc[- ]by-nc-sa[- ]4\.0\b|4
cc-by-nc-nd-4.0|by-nc-nd|\bcc[- ]by-nc-nd[- ]4\.0\b|4
cc-by-4.0|creative commons|\bcreative commons attribution(?: international)?(?: licen[cs]e)?,? 4\.0\b|4
cc-by-3.0|creative commons|\bcreative commons attribution(?: unported)?(?: licen[cs]e)?,? 3\.0\b|4
cc-by-sa-4.0|creative commons|\bcreative commons attribution[- ]share ?alike(?: international)?(?: licen[cs]e)?,? 4\.0\b|4
cc-by-sa-3.0|creative commons|\bcreative commons attribution[- ]share ?alike(?: unported)?(?: licen[cs]e)?,? 3\.0\b|4
cc-by-nc-4.0|creative commons|\bcreative commons attribution[- ]non-?commercial(?: international)?(?: licen[cs]e)?,? 4\.0\b|4
cc-by-nd-4.0|creative commons|\bcreative commons attribution[- ]no-?deriv\w*(?: international)?(?: licen[cs]e)?,? 4\.0\b|4
# Names.
apache|apache|\bapache(?: software)? licen[cs]e\b|5
mit|mit licen|\bmit licen[cs]e\b|5
mit-0|mit no attribution|\bmit no attribution\b|5
x11|x11 licen|\bx11 licen[cs]e\b|5
bsd-2-clause|simplified bsd|\bsimplified bsd licen[cs]e\b|5
bsd-2-clause|freebsd licen|\bfreebsd licen[cs]e\b|5
bsd-2-clause|2-clause|\bbsd[- ]2-clause\b|5
bsd-2-clause|2-clause|\b2-clause bsd\b|5
bsd-3-clause|3-clause|\bbsd[- ]3-clause\b|5
bsd-3-clause|3-clause|\b3-clause bsd\b|5
bsd-3-clause|new bsd|\bnew bsd licen[cs]e\b|5
bsd-3-clause|modified bsd|\bmodified bsd licen[cs]e\b|5
bsd-4-clause|original bsd|\boriginal bsd licen[cs]e\b|5
bsd|bsd licen|\bbsd licen[cs]e\b|5
gpl|general public|(?<!lesser )(?<!affero )(?<!library )\bgeneral public licen[cs]e\b|5
lgpl|lesser general public|\blesser general public licen[cs]e\b|5
lgpl|library general public|\blibrary general public licen[cs]e\b|5
agpl|affero general public|\baffero general public licen[cs]e\b|5
gpl|gnu gpl|\bgnu gpl\b|5
lgpl|gnu lgpl|\bgnu lgpl\b|5
gfdl|free documentation|\bgnu free documentation licen[cs]e\b|5
mpl|mozilla public|\bmozilla public licen[cs]e\b|5
epl|eclipse public|\beclipse public licen[cs]e\b|5
edl|eclipse distribution|\beclipse distribution licen[cs]e\b|5
cddl|common development and distribution|\bcommon development and distribution licen[cs]e\b|5
cpl|common public licen|\bcommon public licen[cs]e\b|5
eupl|european union public|\beuropean union public licen[cs]e\b|5
artistic|artistic licen|\bartistic licen[cs]e\b|5
bsl|boost software|\bboost software licen[cs]e\b|5
isc|isc licen|\bisc licen[cs]e\b|5
zlib|zlib|\bzlib(?:/libpng)? licen[cs]e\b|5
unlicense|the unlicense|\bthe unlicense\b|5
wtfpl|wtfpl|\bwtfpl\b|5
ofl|open font licen|\bopen font licen[cs]e\b|5
osl|open software licen|\bopen software licen[cs]e\b|5
afl|academic free|\bacademic free licen[cs]e\b|5
psf|python software|\bpython software foundation licen[cs]e\b|5
ruby|ruby licen|\bruby licen[cs]e\b|5
php|php licen|\bphp licen[cs]e\b|5
vim|vim licen|\bvim licen[cs]e\b|5
ms-pl|microsoft public|\bmicrosoft public licen[cs]e\b|5
ms-rl|microsoft reciprocal|\bmicrosoft reciprocal licen[cs]e\b|5
odbl|open database|\bopen database licen[cs]e\b|5
odc-by|open data commons|\bopen data commons attribution licen[cs]e\b|5
busl|business source|\bbusiness source licen[cs]e\b|5
sspl|server side public|\bserver side public licen[cs]e\b|5
elastic|elastic licen|\belastic licen[cs]e\b|5
commons-clause|commons clause|\bcommons clause\b|5
cecill|cecill|\bcecill(?:-[bc])?\b|5
ncsa|ncsa|\buniversity of illinois/ncsa open source licen[cs]e\b|5
ipl|ibm public|\bibm public licen[cs]e\b|5
apsl|apple public|\bapple public source licen[cs]e\b|5
ogl|open government|\bopen government licen[cs]e\b|5
openrail|openrail~open rail|\b(?:big(?:science|code) )?open ?rail(?:-[ms])?\b|5
llama|community licen|\bllama \d(?:\.\d)? community licen[cs]e\b|5
cc0|cc0|\bcc0\b|5
cc-by-sa|by-sa|\bcc[- ]by-sa\b|5
cc-by-nc|by-nc|\bcc[- ]by-nc\b|5
cc-by-nd|by-nd|\bcc[- ]by-nd\b|5
cc-by-nc-sa|by-nc-sa|\bcc[- ]by-nc-sa\b|5
cc-by-nc-nd|by-nc-nd|\bcc[- ]by-nc-nd\b|5
cc-by|creative commons|\bcreative commons attribution\b|5
cc-by-sa|creative commons|\bcreative commons attribution[- ]share ?alike\b|5
cc-by-nc|creative commons|\bcreative commons attribution[- ]non-?commercial\b|5
cc-by-nd|creative commons|\bcreative commons attribution[- ]no-?deriv\w*|5
cc|creative commons|\bcreative commons\b|5
"""


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


def rules() -> list[Rule]:
    """The signatures in order. The pattern may contain the separator; the label and keyword don't."""
    out = []
    for line in SIGNATURES.strip().split("\n"):
        if not line.startswith("#"):
            label, keyword, rest = line.split("|", 2)
            pattern, priority = rest.rsplit("|", 1)
            out.append(Rule(label, keyword, pattern, int(priority)))
    return out


TAG = "{tag}"

#: Score of the best detection's priority.
_SCORES = (1.0, 0.95, 0.95, 0.85, 0.8, 0.6)

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Scanner:
    """The compiled rules by keyword."""

    def __init__(self) -> None:
        self.by_keyword: dict[str, list[tuple[int, str, re.Pattern]]] = {}
        for r in rules():
            self.by_keyword.setdefault(r.keyword, []).append((r.priority, r.label, re.compile(r.pattern)))

    def detect(self, text: str) -> list[tuple[int, int, int, str]]:
        """(priority, start, end, label) of the detections that stay, best first."""
        found = []
        for keyword, own in self.by_keyword.items():
            if any(k in text for k in keyword.split("~")):
                found += [(priority, m.start(), m.end(), m.group(1) if label == TAG else label) for priority, label, pattern in own for m in pattern.finditer(text)]
        return suppressed(found)


def suppressed(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Those that don't lie inside one of higher priority or a longer or earlier one of the same, by sweeps over sorted starts."""
    stay: list[tuple[int, int, int, str]] = []
    starts: list[int] = []
    ends: list[int] = []  # the furthest end of the kept ones up to each start
    for _, level in groupby(sorted(found, key=lambda x: (x[0], x[1], -x[2], x[3])), key=lambda x: x[0]):
        reach, kept = -1, []
        for x in level:
            at = bisect_right(starts, x[1])
            if x[2] > reach and not (at and ends[at - 1] >= x[2]):
                kept.append(x)
            reach = max(reach, x[2])
        stay += kept
        ordered = sorted((x[1], x[2]) for x in stay)
        starts, ends = [x[0] for x in ordered], list(accumulate((x[1] for x in ordered), max))
    return stay


def base_places(padded: bytes) -> list[tuple[int, str]]:
    """(first word's number, label) of each base phrase; ``padded``: the words with single spaces between and around."""
    out = []
    for phrase, label in BASE:
        needle, at, number = f" {phrase} ".encode(), 0, 0
        while (to := padded.find(needle, at)) >= 0:
            number += padded.count(b" ", at, to)
            out.append((number, label))
            number, at = number + 1, to + 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    names = "doc_id n_words n_base first_word last_word base_labels labels score spans".split()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    for batch in batches:
        rows = []
        for raw in batch.column(1).cast(pa.large_binary()).to_pylist():
            words = (raw or b"").translate(_WORDS).split()
            places = base_places(b" " + b" ".join(words) + b" ")
            base = {label for _, label in places}
            more = scanner.detect(" ".join((raw or b"").decode("utf-8", "replace").lower().split())) if raw else []
            labels = base | {x[3] for x in more}
            score = max([0.8 * bool(base), *(_SCORES[x[0]] for x in more)])
            starts = [at for at, _ in places]
            spans = ",".join(f"{x[3]}:{x[1]}:{x[2]}" for x in sorted(more, key=lambda x: (x[1], x[2], x[3])))
            rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score), spans))
        columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, word counts and places of the base phrases, labels, score, and the spans of the detections (label:start:end in the text in lower case with single spaces)."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, schema)
