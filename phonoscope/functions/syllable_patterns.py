"""Consonant and vowel patterns of syllables.

A colon in a pattern of closing consonants marks where it may part between two syllables.
"""

from __future__ import annotations

# Patterns, and endings that follow a prefix.
AFTER_SIBILANT = """
    br bw by d dy dw djr dr fr fy fw gr gw gy c cw cy k kl kr kw ky l lw m my mw mr ml n ny nw nr p pl pr pw t
    ty tw tr txr tx dj w j
""".split()
AFTER_NASAL = """
    bf bF bv bV bz bZ bs bS bx bX bj bJ bc bct bcT bck bcK bC bCd bCk bCK v V f F z Z s S x X j J c ct cT ck cK
    C Cd CD Ck CK
""".split()
AFTER_LABIAL = """
    v f v z s x j V F V Z S X J c ct ck cT cK C Cd Ck CD CK :'
""".split()
AFTER_G = """
    j x jd jg jk jt xk xt J X JD Jg Jk JK JT Xk XK XT b p d t f v s z d T F V S Z H
""".split()
AFTER_K = """
    j x xk xt J X Xk Xt XK XT xK xT p t f s T F S H
""".split()
AFTER_F = """
    x s sk st k ks kx t ts tx p ps px c cs cx :'
""".split()
AFTER_V = """
    j z s k ks kx g gz gj t ts tx d ds dz dj p ps b bz c cs cx C Cz Cj
""".split()
OPENING = """
    u$ bl bj bz bs br bw by cl cr cw cy Cl Cr Cw Cy dj dl dr dw dy dz fl fr fw fy fs fv fm fn fc fC gl gr gw gy
    gz gs gj gC hr hl hw hy hm hn jr jl jm jn kl kr kw ky kx kc kC ks mr mw ml my nr nw nl ny pl pr pw py pj px
    ps pz pc pC qr q:l qw qy tr ts tz tz:w tz:y tl tw tx tj vl vr vw vy vm vn wr xw jw
""".split()
SINGLE = """
    b c C d f g h j k l m n p q r s t v w x y z G Q ' B D F H J K L N R S T V X Z dj dx tx
""".split()
CLOSING = """
    ' yg wg yk wk ts tz yd wd yt wt yb wb yp wp yz ys wz ws yj yx wj wx yC yc w:r wC wc tx:s
    lf:' l:f lfs lfs:t lfs:k lfs:z fs fs:z
    m:k n:k q:k b:b c:c C:C d:d
    f:f g:g j:j k:k l:l d:dj dj:dj m:m n:n p:p q:q r:r s:s t:t v:v w:w x:x yy z:z D:D F:F G:G J:J K:K L:L D:DJ DJ:DJ N:N
    Q:Q R:R S:S T:T V:V W:W X:X YY Z:Z l:kt l:tx l:txc l:txs l:dj l:djz l:t l:p lz ls ls:t ls:p ls:f ls:c lz:v mf mf:t m:H
    mj:k mj:t rm:j rm:s rm:x rn:j rn:s rn:x mp mp:f mpf:t mp:H mpk mp:s mp:sk mp:st mpt ms ms:k ms:t mt mv mv:t mx:k mx:t
    mz mz:k mz:t nd nd:k nd:p nd:t ng:d ng:st n:sk n:st nt nz nz:d rm:p rn:t sj sj:d sn:j sn:d njd njt mjd mjt nxt mxt
    sn:t
""".split()
WHOLE = """
    'l txm txn txq spldj sprdj sprdjd spldjd spldjt spltxt spltxp brn brq brm prn prq prm krn krq krm trn trq trm brv brvz
    brvzd brvzt brvs brvc brvC brvsts brvst brvsk prv prvz prvzd prvzt prvs prvt prvc prvC prvsts prvst prvsks prvsk 'r 'l 'w
    'y
""".split()
VOWELS = """
    u$i u$e u$a u$o u$u u$I u$E u$A u$O u$U iu$ eu$ au$ ou$ uu$ Iu$ Eu$ Au$ Ou$ Uu$ i e a o u I E A O U i$ e$ a$ o$
    u$ o$u o$i o$a ai au ei oi ou iu ui Ii Ei Ee Eo Eu Ai Ae Aa Ao Au OU Oa Oe Oi UE Ua ae ao oa io ua uo ea eo
    oe e$i Iu Ui AI aI eI
""".split()
#: Prefixes that the endings above follow.
ENDINGS = {
    "OPENING": [("s z x j", AFTER_SIBILANT)],
    "CLOSING": [
        ("b p rb rp lb lp v lv rv f lf rf ln rm lm", AFTER_LABIAL),
        ("m rm n rn r l lm ln", AFTER_NASAL),
        ("g rg lg mg ng qg", AFTER_G),
        ("k rk lk mk nk qk", AFTER_K),
        ("f rf lf", AFTER_F),
        ("v rv lv", AFTER_V),
    ],
}
# End of fixed values.


def patterns(listed: list[str], kind: str = "") -> list[str]:
    """The patterns of a list with its generated ones, without those that double a sound and repeats: longest first, and of one length those that part first."""
    made = [p + e for prefixes, endings in ENDINGS.get(kind, []) for p in prefixes.split() for e in endings]
    plain = {x for x in [*listed, *made] if all(a != b for a, b in zip(x, x[1:], strict=False))}
    return sorted(plain, key=lambda x: (-len(x), ":" not in x, x))
