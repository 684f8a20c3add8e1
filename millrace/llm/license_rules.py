r"""Signature rules of licences: ``priority | label | keyword | pattern``, one rule a line, in order.

Patterns run over a text's words, lower-cased and joined by single spaces, and start and end at words.  The keyword is a word of every match of the
pattern; a text without it is never searched for the rule.  Priorities: 1 wording of a licence's own text, 2 a grant or an identifier, 3 a name with
its version, 4 a name, 5 a hint.  Within a priority the longer match goes first, then the earlier rule.
"""

RULES = r"""
1 | mit | merchantability | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction(?: \w+){0,160}? merchantability
1 | mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
1 | mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 | mit-0 | sublicense | permission is hereby granted(?: \w+){0,40}? sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
1 | x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
1 | isc | disclaims | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that(?: \w+){0,40}? disclaims
1 | 0bsd | disclaims | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims
1 | bsd-2 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer(?: 2)? redistributions in binary form must reproduce the above copyright notice
1 | bsd-3 | endorse | neither the names? of(?: \w+){1,12}? nor the names? of its contributors may be used to endorse or promote products
1 | bsd-4 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
1 | bsd-3-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
1 | apache-1.1 | acknowledgment | this product includes software developed by the apache software foundation(?: \w+){0,20}? acknowledgment
1 | apache-2 | terms | terms and conditions for use reproduction and distribution 1 definitions
1 | apache-2 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
1 | apache-2 | file | you may not use this file except in compliance with the license you may obtain a copy of the license
1 | gpl | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
1 | gpl-2 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2
1 | gpl-3 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3
1 | gpl | redistribute | redistribute it and or modify it under the terms of the gnu general public license
1 | lgpl-2.1 | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
1 | lgpl-3 | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3
1 | lgpl-2 | redistribute | redistribute it and or modify it under the terms of the gnu library general public license
1 | lgpl | redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license
1 | agpl-3 | redistribute | redistribute it and or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation (?:either )?version 3)?
1 | gpl-no-warranty | warranty | but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
1 | fdl-1.3 | document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
1 | fdl-1.2 | document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
1 | fdl-1.1 | document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1
1 | mpl-1.1 | contents | the contents of this file are subject to the mozilla public license version 1 1
1 | mpl-1.0 | contents | the contents of this file are subject to the mozilla public license version 1 0
1 | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v(?:ersion )? ?2 0
1 | epl-1.0 | accompanying | (?:this program and )?the accompanying materials are made available under the terms of the eclipse public license v1 0
1 | epl-2.0 | accompanying | (?:this program and )?the accompanying materials are made available under the terms of the eclipse public license 2 0
1 | cddl-1.0 | contents | the contents of this file are subject to the terms of the common development and distribution license
1 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 | wtfpl | want | (?:do what the fuck you want to public license|you just do what the fuck you want to)
1 | zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
1 | bsl-1.0 | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
1 | beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
1 | openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
1 | postgresql | documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 | ofl-1.1 | font | permission is hereby granted free of charge to any person obtaining a copy of the font software
1 | cc0-1.0 | waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
1 | cc | licensor | by exercising the licensed rights \w* ?you accept and agree to be bound by the terms and conditions of this creative commons(?: \w+){0,40}? licensor
1 | unicode | unicode | unicode data files and software(?: \w+){0,20}? permission is hereby granted
1 | jsonlic | evil | the software shall be used for good not evil
1 | bigscience-rail | restrictions | use based restrictions as referenced in paragraph 5
1 | llama-2 | llama | llama 2 is licensed under the llama 2 community license
1 | llama-3 | llama | meta llama 3 is licensed under the meta llama 3 community license
1 | elastic-2.0 | managed | you may not provide the software to third parties as a hosted or managed service
1 | sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
1 | busl-1.1 | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
2 | mit | mit | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of the )?(?:expat )?mit(?: style)? licen[sc]e
2 | mit | mit | spdx license identifier mit
2 | mit-0 | mit | spdx license identifier mit 0
2 | mit | opensource | opensource org licenses mit(?: license)?(?: php| html)?
2 | mit | mit | (?:dual licensed|licensed) under (?:the )?mit (?:and|or) (?:the )?(?:gpl|apache|bsd)
2 | apache-2 | apache | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of the )?apache licen[sc]e version 2(?: 0)?
2 | apache-2 | apache | spdx license identifier apache 2 0
2 | apache-2 | apache | www apache org licenses license 2 0(?: txt| html)?
2 | apache-2 | opensource | opensource org licenses apache 2 0
2 | apache-1.1 | apache | spdx license identifier apache 1 1
2 | apache-1.0 | apache | spdx license identifier apache 1 0
2 | gpl-3 | gnu | licensed under the gnu general public licen[sc]e (?:version|v) ?3(?: 0)?(?: or (?:\w+ )?later)?
2 | gpl-2 | gnu | licensed under the gnu general public licen[sc]e (?:version|v) ?2(?: 0)?(?: or (?:\w+ )?later)?
2 | gpl | gnu | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of the )?gnu general public licen[sc]e
2 | gpl-3+ | gpl | spdx license identifier gpl 3 0(?: or later)
2 | gpl-3 | gpl | spdx license identifier gpl 3 0(?: only)?
2 | gpl-2+ | gpl | spdx license identifier gpl 2 0(?: or later)
2 | gpl-2 | gpl | spdx license identifier gpl 2 0(?: only)?
2 | gpl-1 | gpl | spdx license identifier gpl 1 0(?: only| or later)?
2 | lgpl-3 | lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
2 | lgpl-2.1 | lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
2 | lgpl-2 | lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
2 | agpl-3 | agpl | spdx license identifier agpl 3 0(?: only| or later)?
2 | gpl-3 | gnu | www gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
2 | gpl-2 | gnu | www gnu org licenses(?: old licenses)? gpl 2 0(?: en)?(?: html| txt)?
2 | gpl | gnu | www gnu org licenses gpl(?: html| txt)?
2 | lgpl | gnu | www gnu org licenses lgpl(?: 3 0| 2 1)?(?: en)?(?: html| txt)?
2 | agpl-3 | gnu | www gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?
2 | bsd-2 | bsd | spdx license identifier bsd 2 clause
2 | bsd-3 | bsd | spdx license identifier bsd 3 clause
2 | bsd-4 | bsd | spdx license identifier bsd 4 clause
2 | 0bsd | 0bsd | spdx license identifier 0bsd
2 | bsd | bsd | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of the )?(?:\w+ )?bsd(?: style)? licen[sc]e
2 | bsd | bsd | use of this source code is governed by a bsd style licen[sc]e
2 | isc | isc | spdx license identifier isc
2 | isc | isc | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?isc licen[sc]e
2 | zlib | zlib | spdx license identifier zlib
2 | unlicense | unlicense | spdx license identifier unlicense
2 | unlicense | unlicense | (?:licensed|released|distributed|available|dedicated) under (?:the )?unlicense
2 | mpl-2.0 | mpl | spdx license identifier mpl 2 0
2 | mpl-1.1 | mpl | spdx license identifier mpl 1 1
2 | mpl-2.0 | mozilla | mozilla org mpl 2 0
2 | mpl | mozilla | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of the )?mozilla public licen[sc]e
2 | epl-2.0 | epl | spdx license identifier epl 2 0
2 | epl-1.0 | epl | spdx license identifier epl 1 0
2 | epl | eclipse | www eclipse org legal epl(?: v10| 2 0| v20)?(?: html)?
2 | cddl-1.0 | cddl | spdx license identifier cddl 1 0
2 | eupl-1.2 | eupl | spdx license identifier eupl 1 2
2 | eupl-1.2 | eupl | licensed under the eupl(?: version| v)? 1 2
2 | bsl-1.0 | bsl | spdx license identifier bsl 1 0
2 | bsl-1.0 | boost | distributed under the boost software licen[sc]e(?: version 1 0)?
2 | artistic-2.0 | artistic | spdx license identifier artistic 2 0
2 | artistic | artistic | licensed under the artistic licen[sc]e
2 | perl | perl | under the same terms as perl(?: itself)?
2 | wtfpl | wtfpl | spdx license identifier wtfpl
2 | cc0-1.0 | cc0 | spdx license identifier cc0 1 0
2 | cc-by-4.0 | cc | spdx license identifier cc by 4 0
2 | cc-by-sa-4.0 | cc | spdx license identifier cc by sa 4 0
2 | cc-by-nc-4.0 | cc | spdx license identifier cc by nc 4 0
2 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
2 | public-domain | creativecommons | creativecommons org publicdomain mark 1 0
2 | cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd(?: [1-4] [05])?
2 | cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa(?: [1-4] [05])?
2 | cc-by-nc | creativecommons | creativecommons org licenses by nc(?: [1-4] [05])?
2 | cc-by-nd | creativecommons | creativecommons org licenses by nd(?: [1-4] [05])?
2 | cc-by-sa | creativecommons | creativecommons org licenses by sa(?: [1-4] [05])?
2 | cc-by | creativecommons | creativecommons org licenses by(?: [1-4] [05])?
2 | odbl-1.0 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
2 | odc-by-1.0 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
2 | pddl-1.0 | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
2 | cc-by-nc | cc | (?:licensed|released|distributed|available|provided|published|shared) under (?:a |the )?cc by nc(?: [1-4] [05])?
2 | cc-by-nc-sa | cc | (?:licensed|released|distributed|available|provided|published|shared) under (?:a |the )?cc by nc sa(?: [1-4] [05])?
2 | cc-by-nc-nd | cc | (?:licensed|released|distributed|available|provided|published|shared) under (?:a |the )?cc by nc nd(?: [1-4] [05])?
2 | cc-by-sa | cc | (?:licensed|released|distributed|available|provided|published|shared) under (?:a |the )?cc by sa(?: [1-4] [05])?
2 | cc-by-nd | cc | (?:licensed|released|distributed|available|provided|published|shared) under (?:a |the )?cc by nd(?: [1-4] [05])?
2 | cc-by | cc | (?:licensed|released|distributed|available|provided|published|shared) under (?:a |the )?cc by(?: [1-4] [05])?
2 | cc0-1.0 | cc0 | (?:licensed|released|distributed|available|dedicated|published|shared) under (?:a |the )?cc0(?: 1 0)?
2 | ogl-uk-3.0 | government | contains public sector information licensed under the open government licen[sc]e v3 0
2 | public-domain | domain | (?:released into|dedicated to|placed in|in) the public domain
2 | all-rights-reserved | reserved | all rights reserved
2 | proprietary | confidential | proprietary and confidential
2 | proprietary | prohibited | unauthori[sz]ed (?:copying|reproduction|distribution)(?: \w+){0,8}? (?:is )?(?:strictly )?prohibited
2 | proprietary | permission | (?:may not|must not|cannot) be (?:copied|reproduced|distributed|redistributed)(?: \w+){0,8}? without (?:the )?(?:prior |express |written )*permission
3 | mit-0 | mit | mit no attribution(?: licen[sc]e)?
3 | apache-2 | apache | apache licen[sc]e (?:version |v )?2(?: 0)?
3 | apache-2 | apache | apache (?:version |v )?2(?: 0)?(?: licen[sc]e)?
3 | apache-2 | apache | apache software licen[sc]e (?:version )?2(?: 0)?
3 | apache-1.1 | apache | apache (?:software )?licen[sc]e (?:version )?1 1
3 | apache-1.0 | apache | apache (?:software )?licen[sc]e (?:version )?1 0
3 | gpl-3+ | gpl | gpl (?:version |v )?3(?: 0)? (?:or later|or any later version)
3 | gpl-3 | gpl | gpl (?:version |v )?3(?: 0)?
3 | gpl-2+ | gpl | gpl (?:version |v )?2(?: 0)? (?:or later|or any later version)
3 | gpl-2 | gpl | gpl (?:version |v )?2(?: 0)?
3 | gpl-3 | gplv3 | (?:gnu )?gplv3
3 | gpl-2 | gplv2 | (?:gnu )?gplv2
3 | gpl-3 | general | general public licen[sc]e (?:version |v )?3(?: 0)?
3 | gpl-2 | general | general public licen[sc]e (?:version |v )?2(?: 0)?
3 | lgpl-3 | lgpl | lgpl (?:version |v )?3(?: 0)?
3 | lgpl-2.1 | lgpl | lgpl (?:version |v )?2 1
3 | lgpl-3 | lgplv3 | (?:gnu )?lgplv3
3 | lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
3 | lgpl-3 | lesser | lesser general public licen[sc]e (?:version |v )?3(?: 0)?
3 | lgpl-2.1 | lesser | lesser general public licen[sc]e (?:version |v )?2 1
3 | lgpl-2 | library | (?:gnu )?library general public licen[sc]e(?: version 2)?
3 | agpl-3 | agpl | agpl (?:version |v )?3(?: 0)?
3 | agpl-3 | agplv3 | (?:gnu )?agplv3
3 | agpl-3 | affero | affero general public licen[sc]e (?:version |v )?3(?: 0)?
3 | bsd-2 | bsd | (?:2|two) clause bsd(?: licen[sc]e)?
3 | bsd-3 | bsd | (?:3|three) clause bsd(?: licen[sc]e)?
3 | bsd-4 | bsd | (?:4|four) clause bsd(?: licen[sc]e)?
3 | bsd-2 | bsd | bsd (?:2|two) clause(?: licen[sc]e)?
3 | bsd-3 | bsd | bsd (?:3|three) clause(?: licen[sc]e)?
3 | bsd-4 | bsd | bsd (?:4|four) clause(?: licen[sc]e)?
3 | bsd-2 | simplified | simplified bsd(?: licen[sc]e)?
3 | bsd-3 | bsd | (?:new|modified|revised) bsd(?: licen[sc]e)?
3 | bsd-4 | bsd | (?:original|old) bsd(?: licen[sc]e)?
3 | 0bsd | bsd | (?:zero|0) clause bsd(?: licen[sc]e)?
3 | mpl-2.0 | mozilla | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
3 | mpl-1.1 | mozilla | mozilla public licen[sc]e (?:version |v )?1 1
3 | mpl-2.0 | mpl | mpl (?:version |v )?2(?: 0)?
3 | mpl-1.1 | mpl | mpl (?:version |v )?1 1
3 | epl-2.0 | eclipse | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
3 | epl-1.0 | eclipse | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
3 | cddl-1.1 | cddl | cddl (?:version |v )?1 1
3 | cddl-1.0 | cddl | cddl (?:version |v )?1 0
3 | cpl-1.0 | common | common public licen[sc]e (?:version )?1 0
3 | eupl-1.2 | european | european union public licen[sc]e (?:version |v )?1 2
3 | eupl-1.1 | european | european union public licen[sc]e (?:version |v )?1 1
3 | artistic-2.0 | artistic | artistic licen[sc]e (?:version )?2 0
3 | artistic-1.0 | artistic | artistic licen[sc]e (?:version )?1 0
3 | afl-3.0 | academic | academic free licen[sc]e (?:version |v )?3 0
3 | osl-3.0 | open | open software licen[sc]e (?:version |v )?3 0
3 | ofl-1.1 | sil | sil open font licen[sc]e (?:version )?1 1
3 | ogl-uk-3.0 | government | open government licen[sc]e (?:version |v )?3(?: 0)?
3 | ogl-uk-3.0 | government | open government licen[sc]e v3(?: 0)?
3 | etalab-2.0 | ouverte | licence ouverte(?: open licence)?(?: version)? 2 0
3 | dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung(?: version)? 2 0
3 | python-2.0 | python | python software foundation licen[sc]e(?: version 2)?
3 | php-3.01 | php | php licen[sc]e version 3 01
3 | zpl-2.1 | zope | zope public licen[sc]e (?:version )?2 1
3 | w3c | w3c | w3c software(?: and document)?(?: notice and)? licen[sc]e
3 | ms-pl | microsoft | microsoft public licen[sc]e
3 | ms-rl | microsoft | microsoft reciprocal licen[sc]e
3 | busl-1.1 | business | business source licen[sc]e (?:version )?1 1
3 | sspl-1.0 | server | server side public licen[sc]e(?: version 1)?
3 | elastic-2.0 | elastic | elastic licen[sc]e (?:version |v )?2(?: 0)?
3 | cc-by-nc-nd-4.0 | noncommercial | attribution noncommercial noderivat(?:ive)?s(?: works)? 4 0(?: international)?
3 | cc-by-nc-sa-4.0 | noncommercial | attribution noncommercial sharealike 4 0(?: international)?
3 | cc-by-nc-4.0 | noncommercial | attribution noncommercial 4 0(?: international)?
3 | cc-by-nd-4.0 | attribution | attribution noderivat(?:ive)?s 4 0(?: international)?
3 | cc-by-sa-4.0 | attribution | attribution share ?alike 4 0(?: international)?
3 | cc-by-4.0 | attribution | attribution 4 0(?: international)?
3 | cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
3 | cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
3 | cc-by-nc-4.0 | cc | cc by nc 4 0
3 | cc-by-nd-4.0 | cc | cc by nd 4 0
3 | cc-by-sa-4.0 | cc | cc by sa 4 0
3 | cc-by-4.0 | cc | cc by 4 0
3 | cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
3 | cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
3 | cc-by-nc-3.0 | cc | cc by nc 3 0
3 | cc-by-nd-3.0 | cc | cc by nd 3 0
3 | cc-by-sa-3.0 | cc | cc by sa 3 0
3 | cc-by-3.0 | cc | cc by 3 0
3 | cc0-1.0 | cc0 | cc0 1 0(?: universal)?
3 | odbl-1.0 | database | open (?:data commons open )?database licen[sc]e(?: v1 0| 1 0)?
3 | openrail-m | openrail | (?:creativeml |bigscience |bigcode )?openrail m(?: v1)?
3 | openrail-m | rail | (?:creativeml |bigscience |bigcode )?open rail m(?: v1)?
3 | llama-3 | llama | llama 3 community licen[sc]e
3 | llama-2 | llama | llama 2 community licen[sc]e
3 | gemma | gemma | gemma terms of use
4 | mit | mit | (?:the )?(?:expat )?mit licen[sc]ed?
4 | mit | expat | expat licen[sc]e
4 | x11 | x11 | x11 licen[sc]e
4 | apache | apache | apache (?:software )?licen[sc]ed?
4 | gpl | gnu | gnu general public licen[sc]e
4 | gpl | gnu | gnu (?:gpl|public licen[sc]e)
4 | lgpl | gnu | gnu lesser general public licen[sc]e
4 | lgpl | gnu | gnu lgpl
4 | agpl | affero | (?:gnu )?affero general public licen[sc]e
4 | fdl | documentation | (?:gnu )?free documentation licen[sc]e
4 | bsd | bsd | (?:\w+ )?bsd(?: style| like)? licen[sc]ed?
4 | isc | isc | isc licen[sc]e
4 | zlib | zlib | zlib(?: libpng)? licen[sc]e
4 | mpl | mozilla | mozilla public licen[sc]e
4 | epl | eclipse | eclipse public licen[sc]e
4 | cddl | common | common development and distribution licen[sc]e
4 | eupl | european | european union public licen[sc]e
4 | artistic | artistic | artistic licen[sc]e
4 | bsl-1.0 | boost | boost software licen[sc]e
4 | ofl | font | (?:sil )?open font licen[sc]e
4 | wtfpl | wtfpl | wtfpl(?: licen[sc]e)?
4 | unlicense | unlicense | (?:the )?unlicense
4 | odbl | odbl | odbl
4 | postgresql | postgresql | postgresql licen[sc]e
4 | cc-by-nc-nd | cc | cc by nc nd
4 | cc-by-nc-sa | cc | cc by nc sa
4 | cc-by-nd | cc | cc by nd
4 | cc-by-sa | cc | cc by sa
4 | cc-by-nc | noncommercial | creative commons attribution noncommercial
4 | cc-by-nc | commercial | creative commons attribution non commercial
4 | cc-by-nc-sa | noncommercial | creative commons attribution noncommercial share ?alike
4 | cc-by-nc-nd | noncommercial | creative commons attribution noncommercial noderiv(?:ative)?s
4 | cc-by-sa | creative | creative commons attribution share ?alike
4 | cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s
4 | cc-by | creative | creative commons attribution
4 | cc0 | cc0 | (?:creative commons )?cc0
4 | ogl | government | open government licen[sc]e
4 | proprietary | proprietary | proprietary (?:software|licen[sc]e|information)
4 | proprietary | agreement | end user licen[sc]e agreement(?: eula)?
4 | proprietary | eula | eula
5 | gpl | gpl | (?:gnu )?gpl(?: licen[sc]ed?)?
5 | lgpl | lgpl | lgpl(?: licen[sc]ed?)?
5 | agpl | agpl | agpl(?: licen[sc]ed?)?
5 | cc | creative | creative commons(?: licen[sc]ed?)?
5 | public-domain | domain | public domain
5 | copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
5 | copyright | reserved | some rights reserved
5 | non-commercial | commercial | (?:for )?non commercial (?:use|purposes?)(?: only)?
5 | non-commercial | noncommercial | (?:for )?noncommercial (?:use|purposes?)(?: only)?
5 | research-only | research | (?:for )?(?:academic )?research (?:use|purposes?) only
5 | unknown-license | licensed | licensed under (?:the |a )?(?:\w+ ){1,5}?licen[sc]e
5 | unknown-license | license | (?:see|read) (?:the )?license(?: file)?(?: for (?:more )?details)?
"""
