"""License signatures, in order of evaluation.

One rule a line: label | keywords | pattern. Texts are matched as lower-case words with
one blank between them, so "GPL-3.0+" reads "gpl 3 0". A rule is tried only where one of
its keywords (parted by commas) occurs as a run of characters, so every text that the
pattern matches must hold one. Headings give the priority of the rules below
them and the confidence of their detections. In a pattern `~` stands for up to six words.
"""

from __future__ import annotations

RULES = r"""
# 90 0.98 grants: a sentence that puts the text under a named license
apache-2 | apache | licensed under the apache license(?: ~)? version 2(?: 0)?
apache-1.1 | apache | licensed under the apache (?:software )?license version 1 1
apache-1.0 | apache | licensed under the apache (?:software )?license version 1 0
mit | mit | (?:released|licensed|distributed|available) under the (?:terms of the )?mit license
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | noninfringement | the software is provided as is without warranty of any kind ~ noninfringement
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | neither the name of ~ may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd-2-clause | bsd | (?:released|licensed|distributed) under the (?:terms of the )?(?:simplified bsd|bsd 2 clause|2 clause bsd) license
bsd-3-clause | bsd | (?:released|licensed|distributed) under the (?:terms of the )?(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) license
bsd | bsd | (?:released|licensed|distributed) under (?:a|the) bsd(?: style)? license
gpl-3 | general public | licensed under the gnu general public license v(?:ersion )?3
gpl-3 | general public | this work is licensed under the gnu general public license version 3
gpl-2 | general public | licensed under the gnu general public license v(?:ersion )?2
gpl-3-or-later | free software | free software ~ redistribute it and or modify it under the terms of the gnu general public license ~ version 3 ~ or at your option any later version
gpl-2-or-later | free software | free software ~ redistribute it and or modify it under the terms of the gnu general public license ~ version 2 ~ or at your option any later version
gpl | redistribute it | redistribute it and or modify it under the terms of the gnu general public license
lgpl | redistribute it | redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | redistribute it | redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3 | affero | licensed under the gnu affero general public license(?: ~)? version 3
lgpl-3 | lesser | licensed under the gnu lesser general public license(?: ~)? version 3
lgpl-2.1 | lesser | licensed under the gnu lesser general public license(?: ~)? version 2 1
mpl-2 | mozilla | (?:this source code form is )?subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-2 | eclipse | (?:made available|licensed) under the (?:terms of the )?eclipse public license (?:v|version )?2 0
epl-1 | eclipse | (?:made available|licensed) under the (?:terms of the )?eclipse public license (?:v|version )?1 0
cddl-1 | distribution license | subject to the terms of the common development and distribution license
isc | isc | (?:released|licensed) under the isc license
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | misrepresented | the origin of this software must not be misrepresented
bsl-1 | boost | distributed under the boost software license version 1 0
artistic-2 | artistic | (?:licensed|released) under the (?:terms of the )?artistic license (?:v|version )?2 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | (?:licensed|released) under the wtfpl
cc0-1 | cc0 | (?:released|licensed|dedicated) (?:under|to) (?:the )?(?:creative commons )?cc0
cc-by-4 | commons | licensed under (?:a|the) creative commons attribution 4 0 international license
cc-by-3 | commons | licensed under (?:a|the) creative commons attribution 3 0
cc-by-sa-4 | commons | licensed under (?:a|the) creative commons attribution share ?alike 4 0
cc-by-sa-3 | commons | licensed under (?:a|the) creative commons attribution share ?alike 3 0
cc-by-nc | commons | licensed under (?:a|the) creative commons attribution non ?commercial(?: [234] [05])?(?! (?:share|no))
cc-by-nc | cc by nc | licensed under (?:a |the )?cc by nc(?: [1234] [05])?
cc-by-nc-sa | commons | licensed under (?:a|the) creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | commons | licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nd | commons | licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s
cc-by-sa | cc by sa | licensed under (?:a |the )?cc by sa(?: [1234] [05])?
cc-by | cc by | licensed under (?:a |the )?cc by(?: [1234] [05])?
ofl-1.1 | font | licensed under the sil open font license version 1 1
eupl-1.2 | eupl | licensed under the eupl(?: ~)? 1 2
ms-pl | microsoft | (?:released|licensed) under the microsoft public license
ms-rl | microsoft | (?:released|licensed) under the microsoft reciprocal license
python-2 | psf, python | licensed under the (?:psf|python software foundation) license(?: ~)? 2
ncsa | illinois | released under the university of illinois(?: ncsa)? open source license
postgresql | postgresql | (?:released|licensed) under the postgresql license
openssl | openssl | (?:released|licensed) under the (?:openssl|dual openssl and ssleay) license
odbl-1 | database | made available under the open database license
odc-by-1 | attribution | made available under the (?:open data commons|odc) attribution license
pddl-1 | dedication | made available under the public domain dedication and license
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
sspl-1 | side public | licensed under the server side public license
busl-1.1 | business source | licensed under the business source license(?: ~)? 1 1
elastic-2 | elastic | licensed under the elastic license(?: ~)? 2(?: 0)?
polyform-nc | polyform | licensed under the polyform noncommercial license
commons-clause | commons clause | subject to the commons clause license condition
llama-2 | llama | licensed under the llama 2 community license
llama-3 | llama | licensed under the (?:meta )?llama 3(?: [0-9])? community license
openrail | openrail, open rail, bloom rail | (?:released|licensed) under the (?:creativeml |bigscience )?(?:open ?rail|bloom rail)
# 80 0.95 tags: machine-readable identifiers
apache-2 | spdx | spdx license identifier apache 2 0
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
0bsd | spdx | spdx license identifier 0bsd
gpl-2 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-3 | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3 | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-3-or-later | spdx | spdx license identifier lgpl 3 0 or later
agpl-3 | spdx | spdx license identifier agpl 3 0(?: only)?
agpl-3-or-later | spdx | spdx license identifier agpl 3 0 or later
mpl-2 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | spdx | spdx license identifier mpl 1 1
epl-1 | spdx | spdx license identifier epl 1 0
epl-2 | spdx | spdx license identifier epl 2 0
cddl-1 | spdx | spdx license identifier cddl 1 0
cddl-1.1 | spdx | spdx license identifier cddl 1 1
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
bsl-1 | spdx | spdx license identifier bsl 1 0
artistic-2 | spdx | spdx license identifier artistic 2 0
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
cc0-1 | spdx | spdx license identifier cc0 1 0
cc-by-4 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc | spdx | spdx license identifier cc by nc [1234] [05]
cc-by-nc-sa | spdx | spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-nd | spdx | spdx license identifier cc by nc nd [1234] [05]
cc-by-nd | spdx | spdx license identifier cc by nd [1234] [05]
ofl-1.1 | spdx | spdx license identifier ofl 1 1
eupl-1.2 | spdx | spdx license identifier eupl 1 2
ms-pl | spdx | spdx license identifier ms pl
ms-rl | spdx | spdx license identifier ms rl
python-2 | spdx | spdx license identifier (?:python|psf) 2 0
ncsa | spdx | spdx license identifier ncsa
postgresql | spdx | spdx license identifier postgresql
openssl | spdx | spdx license identifier openssl
odbl-1 | spdx | spdx license identifier odbl 1 0
gfdl-1.3 | spdx | spdx license identifier gfdl 1 3
sspl-1 | spdx | spdx license identifier sspl 1 0
busl-1.1 | spdx | spdx license identifier busl 1 1
elastic-2 | spdx | spdx license identifier elastic 2 0
upl-1 | spdx | spdx license identifier upl 1 0
ecl-2 | spdx | spdx license identifier ecl 2 0
afl-3 | spdx | spdx license identifier afl 3 0
osl-3 | spdx | spdx license identifier osl 3 0
vim | spdx | spdx license identifier vim
x11 | spdx | spdx license identifier x11
curl | spdx | spdx license identifier curl
mulanpsl-2 | spdx | spdx license identifier mulanpsl 2 0
# 70 0.9 names with versions
gpl-3 | general public | gnu general public license (?:version |v)?3(?: 0)?
gpl-2 | general public | gnu general public license (?:version |v)?2(?: 0)?
gpl-1 | general public | gnu general public license (?:version |v)?1(?: 0)?
lgpl-3 | lesser | gnu lesser general public license (?:version |v)?3(?: 0)?
lgpl-2.1 | lesser | gnu lesser general public license (?:version |v)?2 1
lgpl-2 | library general | gnu library general public license (?:version |v)?2(?: 0)?
agpl-3 | affero | gnu affero general public license (?:version |v)?3(?: 0)?
agpl-1 | affero | affero general public license (?:version |v)?1(?: 0)?
gfdl-1.3 | free documentation | gnu free documentation license (?:version |v)?1 3
gfdl-1.2 | free documentation | gnu free documentation license (?:version |v)?1 2
gfdl-1.1 | free documentation | gnu free documentation license (?:version |v)?1 1
apache-2 | apache | apache license (?:version |v )?2(?: 0)?
apache-2 | apache | apache 2(?: 0)? license
apache-1.1 | apache | apache (?:software )?license (?:version |v )?1 1
apache-1.0 | apache | apache (?:software )?license (?:version |v )?1 0
mpl-2 | mozilla | mozilla public license (?:version |v )?2 0
mpl-1.1 | mozilla | mozilla public license (?:version |v )?1 1
mpl-1.0 | mozilla | mozilla public license (?:version |v )?1 0
epl-2 | eclipse | eclipse public license (?:version |v )?2 0
epl-1 | eclipse | eclipse public license (?:version |v )?1 0
edl-1 | eclipse | eclipse distribution license (?:version |v )?1 0
cpl-1 | common public | common public license (?:version |v )?1 0
ipl-1 | ibm public | ibm public license (?:version |v )?1 0
cddl-1 | distribution license | common development and distribution license (?:version |v )?1 0
cddl-1.1 | distribution license | common development and distribution license (?:version |v )?1 1
artistic-2 | artistic | artistic license (?:version |v )?2 0
artistic-1 | artistic | artistic license (?:version |v )?1 0
afl-3 | academic free | academic free license (?:version |v )?3 0
osl-3 | open software | open software license (?:version |v )?3 0
ecl-2 | educational | educational community license (?:version |v )?2 0
upl-1 | universal permissive | universal permissive license (?:version |v )?1 0
bsl-1 | boost | boost software license (?:version |v )?1 0
ofl-1.1 | open font | (?:sil )?open font license (?:version |v )?1 1
eupl-1.2 | european union | european union public licen[cs]e (?:version |v )?1 2
eupl-1.1 | european union | european union public licen[cs]e (?:version |v )?1 1
cecill-2.1 | cecill | cecill (?:license )?(?:version |v )?2 1
cecill-2 | cecill | cecill (?:license )?(?:version |v )?2 0
mulanpsl-2 | mulan | mulan permissive software license (?:version |v )?2
php-3 | php | php license (?:version |v )?3 0[0-9]?
zpl-2.1 | zope | zope public license (?:version |v )?2 1
qpl-1 | q public | q public license (?:version |v )?1 0
apsl-2 | apple public | apple public source license (?:version |v )?2 0
rpl-1.5 | reciprocal public | reciprocal public license (?:version |v )?1 5
cpal-1 | common public | common public attribution license (?:version |v )?1 0
sspl-1 | side public | server side public license (?:version |v )?1
busl-1.1 | business source | business source license (?:version |v )?1 1
elastic-2 | elastic | elastic license (?:version |v )?2(?: 0)?
odbl-1 | open database | open database license (?:version |v )?1 0
cc0-1 | cc0 | cc0 1 0(?: universal)?
cc-by-4 | cc by 4 | cc by 4 0
cc-by-3 | cc by 3 | cc by 3 0
cc-by-2.5 | cc by 2 | cc by 2 5
cc-by-sa-4 | cc by sa | cc by sa 4 0
cc-by-sa-3 | cc by sa | cc by sa 3 0
cc-by-nc | cc by nc | cc by nc [1234] [05]
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1234] [05])?
cc-by-nd | cc by nd | cc by nd(?: [1234] [05])?
cc-by-4 | commons | creative commons attribution 4 0
cc-by-3 | commons | creative commons attribution 3 0
cc-by-2 | commons | creative commons attribution 2 0
cc-by-sa-4 | commons | creative commons attribution share ?alike 4 0
cc-by-sa-3 | commons | creative commons attribution share ?alike 3 0
cc-by-nc | commons | creative commons attribution non ?commercial(?! (?:share|no))
cc-by-nc-sa | commons | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?
cc-by-nd | commons | creative commons attribution no ?deriv(?:ative)?s(?: works)?
# 60 0.85 addresses of license texts
apache-2 | licenses | www apache org licenses license 2 0(?: txt| html)?
gpl-3 | gnu | www gnu org licenses gpl 3 0(?: txt| html)?
gpl-2 | gnu | www gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
lgpl-3 | gnu | www gnu org licenses lgpl 3 0(?: txt| html)?
lgpl-2.1 | gnu | www gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?
agpl-3 | gnu | www gnu org licenses agpl 3 0(?: txt| html)?
gfdl | gnu | www gnu org licenses fdl(?: 1 [123])?(?: txt| html)?
mpl-2 | mozilla | (?:www )?mozilla org mpl 2 0
epl-2 | eclipse | www eclipse org legal epl (?:v20|2 0)
epl-1 | eclipse | www eclipse org legal epl v10
mit | opensource | opensource org licen[cs]es? mit
bsd-3-clause | opensource | opensource org licen[cs]es? bsd 3 clause
bsd-2-clause | opensource | opensource org licen[cs]es? bsd 2 clause
isc | opensource | opensource org licen[cs]es? isc
zlib | opensource | opensource org licen[cs]es? zlib
cc-by-4 | creativecommons | creativecommons org licenses by 4 0
cc-by-3 | creativecommons | creativecommons org licenses by 3 0
cc-by-sa-4 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc | creativecommons | creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1234] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1234] [05]
cc0-1 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
bsl-1 | boost | www boost org license 1 0(?: txt)?
unlicense | unlicense | unlicense org
ofl-1.1 | scripts | scripts sil org ofl
wtfpl | wtfpl | www wtfpl net
odbl-1 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
# 50 0.7 names without versions
mit | mit | (?:the )?mit license
mit | expat | expat license
x11 | x11 | x11 license
bsd | bsd | bsd license
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause) bsd
bsd-3-clause | bsd | (?:new|modified|revised|3 clause) bsd
gpl | general public | gnu general public license
lgpl | lesser | gnu lesser general public license
agpl | affero | (?:gnu )?affero general public license
gfdl | free documentation | gnu free documentation license
apache | apache | apache (?:software )?license
mpl | mozilla | mozilla public license
epl | eclipse | eclipse public license
cddl | distribution license | common development and distribution license
artistic | artistic | artistic license
isc | isc | isc license
zlib | zlib | zlib(?: libpng)? license
bsl-1 | boost | boost software license
ofl | open font | (?:sil )?open font license
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
ncsa | ncsa | ncsa open source license
postgresql | postgresql | postgresql license
openssl | openssl | openssl license
python | python | python software foundation license
unicode | unicode | unicode (?:data files and software )?license
sspl | side public | server side public license
wtfpl | what the | do what the fuck you want to public license
cc0 | commons zero | creative commons zero
cc-by-sa | cc by sa | cc by sa
cc-by | cc by | cc by
cc | commons | creative commons license
odbl | open database | open database license
# 40 0.6 short forms
gpl-3 | gpl | gplv3|gpl v3|gpl 3(?: 0)?
gpl-2 | gpl | gplv2|gpl v2|gpl 2(?: 0)?
lgpl-3 | lgpl | lgplv3|lgpl v3|lgpl 3(?: 0)?
lgpl-2.1 | lgpl | lgplv2 1|lgpl v2 1|lgpl 2 1
agpl-3 | agpl | agplv3|agpl v3|agpl 3(?: 0)?
mpl-2 | mpl | mplv2|mpl v2|mpl 2(?: 0)?
epl-2 | epl | eplv2|epl v2|epl 2(?: 0)?
apache-2 | apache, asl | apache v?2(?: 0)?|asl 2(?: 0)?
bsd-2-clause | bsd | bsd 2 clause
bsd-3-clause | bsd | bsd 3 clause
# 20 0.3 notices that name no license
public-domain | public domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
proprietary | proprietary | proprietary and confidential
proprietary | rights reserved | all rights reserved
proprietary | unauthorized | unauthorized copying ~ strictly prohibited
see-license | license | see (?:the )?license file(?: ~ for details)?
copyright | copyright | copyright c (?:19|20)[0-9][0-9]
"""
