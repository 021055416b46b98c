"""Signature rules of license notices, in order of priority: one rule a line, its label, then its pattern.

Patterns are regular expressions over a text's words (lower case, joined by one space; "2.0" is the words "2 0"). The
word in braces is the gate: a rule is tried only where that very word stands.
"""

from __future__ import annotations

import re

RULES_TEXT = r"""
apache-2.0            licensed under the {apache} license version 2 0
apache-2.0            {apache} license version 2 0 january 2004
apache-2.0            {apache} (?:software )?license (?:version |v )?2(?: 0)?
apache-2.0            {apache} 2 0 license
apache-2.0            www {apache} org licenses license 2 0
apache-2.0            spdx license identifier {apache} 2 0
apache-1.1            {apache} software license version 1 1
apache-1.1            spdx license identifier {apache} 1 1
apache-1.0            {apache} (?:software )?license version 1 0
apache                under the (?:terms of the )?{apache} license
apache                the {apache} software license
apache                {apache} license
mit                   permission is hereby granted free of {charge} to any person obtaining a copy
mit                   the above copyright {notice} and this permission notice shall be included
mit                   (?:released|distributed|licensed|available|published) under (?:the )?(?:terms of )?(?:the )?mit {license}
mit                   spdx {license} identifier mit
mit                   {license} mit
mit                   the mit {license}
mit                   opensource org {licenses} mit
mit                   {licensed} under (?:the )?mit
mit                   mit {license}
mit                   mit {licence}
mit                   mit {licensed}
mit-0                 mit no attribution {license}
mit-0                 spdx {license} identifier mit 0
x11                   x11 {license}
x11                   the x {consortium}
expat                 expat {license}
isc                   permission to use copy modify and or distribute this software for any purpose with or without fee is hereby {granted}
isc                   isc {license}
isc                   internet systems {consortium}
isc                   spdx {license} identifier isc
0bsd                  zero {clause} bsd
0bsd                  spdx {license} identifier 0bsd
bsd-4-clause          all advertising materials mentioning features or use of this software must display the following {acknowledgement}
bsd-4-clause          4 {clause} bsd
bsd-4-clause          bsd 4 {clause}
bsd-3-clause          neither the name of .{0,80}contributors may be used to endorse or promote {products}
bsd-3-clause          3 {clause} bsd(?: license)?
bsd-3-clause          bsd 3 {clause}(?: license)?
bsd-3-clause          (?:new|modified|revised) bsd {license}
bsd-2-clause          2 {clause} bsd(?: license)?
bsd-2-clause          bsd 2 {clause}(?: license)?
bsd-2-clause          (?:simplified|freebsd) bsd {license}
bsd                   {redistribution} and use in source and binary forms with or without modification are permitted
bsd                   {redistributions} of source code must retain the above copyright notice
bsd                   {redistributions} in binary form must reproduce the above copyright notice
bsd                   (?:released|distributed|licensed|available) under (?:the )?(?:terms of )?(?:the )?bsd {license}
bsd                   bsd (?:style )?{license}
bsd                   bsd {licensed}
agpl-3.0              gnu {affero} general public license version 3
agpl-3.0              {affero} general public license (?:version |v )?3
agpl-3.0              {agpl}(?: version| v)? ?3(?: 0)?
agpl-3.0              {agplv3}
agpl-1.0              {affero} general public license version 1
agpl                  gnu {affero} general public license
agpl                  {affero} general public license
agpl                  {agpl}
lgpl-3.0              gnu {lesser} general public license version 3
lgpl-3.0              {lesser} general public license (?:version |v )?3
lgpl-3.0              {lgpl}(?: version| v)? ?3(?: 0)?
lgpl-3.0              {lgplv3}
lgpl-2.1              gnu {lesser} general public license version 2 1
lgpl-2.1              {lesser} general public license (?:version |v )?2 1
lgpl-2.1              {lgpl}(?: version| v)? ?2 1
lgpl-2.0              gnu {library} general public license version 2
lgpl-2.0              {library} general public license
lgpl-2.0              {lgpl}(?: version| v)? ?2(?: 0)?
lgpl-2.0              {lgplv2}
lgpl                  gnu {lesser} general public license
lgpl                  {lesser} general public license
lgpl                  {lgpl}
gpl-3.0               gnu general {public} license (?:as published by the free software foundation )?(?:either )?version 3
gpl-3.0               general {public} license (?:version |v )?3
gpl-3.0               gnu {gpl}(?: version| v)? ?3(?: 0)?
gpl-3.0               {gpl}(?: version| v)? ?3(?: 0)?
gpl-3.0               {gplv3}
gpl-2.0               gnu general {public} license (?:as published by the free software foundation )?(?:either )?version 2
gpl-2.0               general {public} license (?:version |v )?2
gpl-2.0               gnu {gpl}(?: version| v)? ?2(?: 0)?
gpl-2.0               {gpl}(?: version| v)? ?2(?: 0)?
gpl-2.0               {gplv2}
gpl-1.0               gnu general {public} license version 1
gpl-1.0               general {public} license version 1
gpl-1.0               {gpl} 1 0
gpl                   this program is free {software} you can redistribute it and or modify it under the terms of the gnu general public license
gpl                   published by the free software {foundation}
gpl                   gnu general {public} license
gpl                   general {public} license
gpl                   gnu {gpl}
gpl                   {gpl}
gfdl-1.3              gnu free {documentation} license version 1 3
gfdl-1.2              gnu free {documentation} license version 1 2
gfdl-1.1              gnu free {documentation} license version 1 1
gfdl                  gnu free {documentation} license
gfdl                  {gfdl}
mpl-2.0               {mozilla} public license (?:version |v )?2 0
mpl-2.0               {mpl} 2 0
mpl-1.1               {mozilla} public license (?:version |v )?1 1
mpl-1.1               {mpl} 1 1
mpl-1.0               {mozilla} public license (?:version |v )?1 0
mpl                   {mozilla} public license
mpl                   mozilla org {mpl}
epl-2.0               {eclipse} public license (?:version |v )?2 0
epl-2.0               {epl} 2 0
epl-1.0               {eclipse} public license (?:version |v )?1 0
epl-1.0               {epl} 1 0
epl                   {eclipse} public license
edl-1.0               {eclipse} distribution license
cddl-1.1              {cddl} 1 1
cddl-1.0              common development and distribution {license} version 1 0
cddl-1.0              {cddl} 1 0
cddl                  common development and distribution {license}
cddl                  {cddl}
cpl-1.0               common public {license} version 1 0
cpl-1.0               {cpl} 1 0
ipl-1.0               ibm public {license}
eupl-1.2              european union public {licence}(?: version| v)? 1 2
eupl-1.2              {eupl} (?:v )?1 2
eupl-1.1              european union public {licence}(?: version| v)? 1 1
eupl-1.1              {eupl} (?:v )?1 1
eupl                  european union public {licen[cs]e}
eupl                  {eupl}
osl-3.0               open software {license} version 3 0
osl                   open software {license}
afl-3.0               academic free {license} version 3 0
afl                   academic free {license}
artistic-2.0          {artistic} license (?:version )?2 0
artistic-1.0          {artistic} license (?:version )?1 0
artistic              the {artistic} license
artistic              {artistic} license
bsl-1.0               {boost} software license version 1 0
bsl-1.0               {boost} software license
bsl-1.0               spdx license identifier {bsl} 1 0
busl-1.1              business source {license}(?: version)? 1 1
busl-1.1              business source {license}
sspl-1.0              server side public {license}
sspl-1.0              {sspl}
elastic-2.0           {elastic} license (?:version )?2 0
elastic               {elastic} license
zlib                  zlib libpng {license}
zlib                  zlib {license}
zlib                  this software is provided as is without any express or {implied} warranty
libpng                libpng {license}
ijg                   independent jpeg {group}
ofl-1.1               sil open font {license}(?: version)? 1 1
ofl-1.1               sil open font {license}
ofl-1.1               open font {license}
unlicense             this is free and unencumbered software released into the {public} domain
unlicense             the {unlicense}
unlicense             {unlicense} org
wtfpl                 do what the fuck you want to {public} license
wtfpl                 {wtfpl}
cc0-1.0               {cc0} 1 0 universal
cc0-1.0               {cc0}
cc0-1.0               {creativecommons} org publicdomain zero
cc-by-nc-nd           {creative} commons attribution noncommercial noderiv(?:ative)?s
cc-by-nc-nd           cc by {nc} nd
cc-by-nc-sa           {creative} commons attribution noncommercial share ?alike
cc-by-nc-sa           cc by {nc} sa
cc-by-nc              {creative} commons attribution noncommercial
cc-by-nc              cc by {nc}
cc-by-nd              {creative} commons attribution noderiv(?:ative)?s
cc-by-nd              {creativecommons} org licenses by nd
cc-by-sa-4.0          {creative} commons attribution share ?alike 4 0
cc-by-sa-4.0          {creativecommons} org licenses by sa 4 0
cc-by-sa-3.0          {creative} commons attribution share ?alike 3 0
cc-by-sa-3.0          {creativecommons} org licenses by sa 3 0
cc-by-sa              {creative} commons attribution share ?alike
cc-by-4.0             {creative} commons attribution 4 0
cc-by-4.0             {creativecommons} org licenses by 4 0
cc-by-3.0             {creative} commons attribution 3 0
cc-by-3.0             {creativecommons} org licenses by 3 0
cc-by                 {creative} commons attribution
cc                    {creative} commons license
cc                    {creative} commons
cc                    {creativecommons} org
odbl-1.0              open database {license}
odbl-1.0              {odbl}
odc-by-1.0            open data commons {attribution}
pddl-1.0              public domain dedication and {license}
cdla-permissive       community data license agreement {permissive}
cdla-sharing          community data {license} agreement sharing
python-2.0            python software {foundation} license
psf                   {psf} license
php-3.01              php {license} version 3 01
php                   php {license}
ruby                  ruby s {license}
ruby                  ruby {license}
perl                  same terms as perl {itself}
tcl                   tcl tk {license}
openssl               openssl {license}
openssl               openssl project for use in the openssl {toolkit}
ssleay                original ssleay {license}
ncsa                  university of illinois ncsa open source {license}
ncsa                  ncsa open source {license}
postgresql            postgresql {license}
curl                  curl {license}
vim                   vim {license}
w3c                   w3c software (?:notice and )?{license}
ms-pl                 microsoft public {license}
ms-rl                 microsoft reciprocal {license}
apsl-2.0              apple public source {license}
qpl-1.0               q public {license}
npl-1.1               netscape public {license}
spl-1.0               sun public {license}
nasa-1.3              nasa open source {agreement}
cecill-2.1            {cecill}(?: version)? 2 1
cecill-b              {cecill} b
cecill-c              {cecill} c
cecill                {cecill}
mulan-psl-2.0         mulan permissive software {license}
blueoak-1.0           blue oak model {license}
upl-1.0               universal permissive {license}
hpnd                  historical permission {notice} and disclaimer
json                  the software shall be used for good not {evil}
beerware              beer ?ware {license}
commons-clause        {commons} clause
polyform              polyform (?:noncommercial|shield|perimeter|strict) {license}
openrail              open ?rail(?: m)? {license}
llama                 llama (?:2|3)? ?community {license}
proprietary           {proprietary} and confidential
proprietary           {confidential} and proprietary
proprietary           unauthorized {copying} of this (?:file|software|document)
proprietary           commercial {license}
eula                  end user {license} agreement
eula                  software {license} agreement
public-domain         released into the public {domain}
public-domain         dedicated to the public {domain}
public-domain         in the public {domain}
public-domain         public {domain}
all-rights-reserved   (?:copyright .{0,60})?all rights {reserved}
all-rights-reserved   tous droits {réservés}
all-rights-reserved   alle rechte {vorbehalten}
all-rights-reserved   todos los derechos {reservados}
copyright             {copyright} (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright             {copyrighted} by
warranty-disclaimer   without {warranties} or conditions of any kind
warranty-disclaimer   without any {warranty}
warranty-disclaimer   {merchantability} (?:and|or) fitness for a particular purpose
warranty-disclaimer   provided as is without {warranty} of any kind
free-software         permission is {granted} to (?:use|copy|modify)
free-software         free software {license}
open-source           open source {license}
spdx                  spdx {license} identifier
license-notice        see the (?:file )?{license} (?:file )?for (?:the )?(?:more )?(?:details|information)
license-notice        licensed under the terms of the {license}
license-notice        {licensed} under the
license-notice        {license} agreement
"""
#: The base phrases and their labels: fixed values of the contract.
BASE_TEXT = """
mit      mit {license}
apache   apache {license}
gpl      general public {license}
"""


def parsed(text: str) -> list[tuple[str, str, str, str]]:
    """(label, words before the gate, gate, words after), the two parts as patterns that end and start at a word."""
    out = []
    for line in filter(None, text.splitlines()):
        label, pattern = line.split(None, 1)
        before, gate, after = re.fullmatch(r"(.*?) ?\{([^\W\d][^{}]*)\}(.*)", pattern.strip()).groups()
        left = rf"(?:^| )(?:{before}) \z" if before else r"\z"
        for word in ("licence", "license") if gate == "licen[cs]e" else (gate,):
            out.append((label, left, word, rf"^(?:{after})(?: |\z)"))
    return out


RULES, BASE = parsed(RULES_TEXT), parsed(BASE_TEXT)
#: Words on either side of the gate that a pattern can reach.
REACH = 24
