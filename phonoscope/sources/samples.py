"""Samples with known results: words of the notation, IPA, and their machine codes, syllables and keys."""

from __future__ import annotations

# Fixed values.
# fmt: off
#: Word, and its machine codes in hexadecimal.
CODES = (
    ('txando^', 'CF36CF63BC7FCF14CF24BD87'),
    ('surdjyo^', 'CF49C09FCF5ECF24CF43CF69BD87'),
    ('HEth~Ah', 'CF3EB01FCF36CF11B22FCF40'),
    ('siqk', 'CF49B85FCF15CF3C'),
    ('txya@+a-a++u', 'CF36CF63CF69BC4CBC76BC77C09F'),
    ('hwpo$kUi^mUno$s', 'CF40CF67CF2CBE84CF3CB64FB757CF12B64FCF14BE84CF49'),
    ('sinho^rEsi', 'CF49B85FCF14CF40BD87CF5EB01FCF49B85F'),
    ("batO_'aH", 'CF27BC7FCF36B38FCF1ABC7FCF3E'),
    ('aiyuQaK', 'BC7FB85FCF69C09FCF1BBC7FCF3B'),
    ("s'oQya&te", 'CF49CF1ABE8FCF1BCF69BC69CF36BA6F'),
    ('t!arEba', 'CF31BC7FCF5EB01FCF27BC7F'),
    ('txhaK!EnEba', 'CF36CF63CF40BC7FCF3AB01FCF14B01FCF27BC7F'),
    ('txh~im', 'CF36CF63CF11B85FCF12'),
    ('txy~h~im', 'CF36CF63CF68CF11B85FCF12'),
    ('mh!im', 'CF12CF3FB85FCF12'),
    ('nh!iqh!lh!', 'CF14CF3FB85FCF15CF3FCF5BCF3F'),
    ('p*at.', 'CF29BC7FCF35'),
    ('t*et.', 'CF32BA6FCF35'),
    ('nulQ~tQ~', 'CF14C09FCF5ACF33'),
    ('b?ad?', 'CF25BC7FCF1E'),
    ('p*od*h~U&u$t*ak*el*', 'CF29BE8FCF20CF11B639C094CF32BC7FCF39BA6FCF59'),
    ('na/\\q', 'CF14BC7CCF15'),
    ('na\\\\q', 'CF14BC7DCF15'),
)
#: IPA, notation, X-SAMPA.
IPA = (
    ('diəm˧˩˨', 'diU--U-m', 'di@m˧˩˨'),
    ('cɤ̆n˧˧', 'ky~O!n', 'c7_Xn˧˧'),
    ('ɲɤ˨˦', 'ny~O-O+', 'J7˨˦'),
    ('uj˧˩˨', 'uu--u-y', 'uj˧˩˨'),
    ('è.ɣì.ɣɔ̀', 'e-Gi-Go$-', 'è.Gì.GO_L'),
    ('àá.fá', 'a-a+fa+', 'àá.fá'),
    ('àà.k͡pɔ̃̀', 'a-a-kpo$&-', 'àà.kpO_~_L'),
    ('àá.ɾĩ́', 'a-a+ri&+', 'àá.4ĩ_H'),
    ('āá.sì.kí', 'aa+si-ki+', 'āá.sì.kí'),
    ('áásìkiriìmù', 'a+a+si-kiri-imu-', 'áásìkiriìmù'),
    ('āá.ʃáà.ī.tà', 'aa+xa+a-ita-', 'āá.Sáà.ī.tà'),
    ('àà.wɛ̀', 'a-a-wE-', 'àà.wE_L'),
    ('àà.jò', 'a-a-yo-', 'àà.jò'),
    ('ʊ̄.mɔ̃̄.lɛ̀', 'Omo$&lE-', 'U_M.mO_~_M.lE_L'),
    ('jà.ú.jà.úù', 'ya-u+ya-u+u-', 'jà.ú.jà.úù'),
    ('ka̠ɡa̠sʰʌ̹ŋd͡ʑa̠', 'ka_u&ga_u&sh~Uqdjy~a_u&', 'ka_-ga_-s_hV_ONdz\\a_-'),
    ('ˈka̠ːɡa̠ɦa̠da̠', 'ka_^u&_ga_u&hh~a_u&da_u&', '"ka_-:ga_-h\\a_-da_-'),
    ('ka̠ɡa̠βo̞βo̞', 'ka_u&ga_u&VoVo', 'ka_-ga_-Bo_oBo_o'),
    ('săw˧˩˨', 'sa!a--a-w', 'săw˧˩˨'),
    ('sɤ̆p˨ˀ˩', "sO-!O--p'", 's7_Xp˨ˀ˩'),
    ('ʔɗəwk͡p̚˧˨ʔ', "'d?UU-wkp.'", '?d_<@wkp_}˧˨?'),
    ('ɑb̥eˈd̥isə', 'apeti^sU', 'Ab_0e"d_0is@'),
    ('t͡ɕɘ(ː)ŋo̞', 'txy~I_qo', 'ts\\@\\(:)No_o'),
    ('t͡ɕʌ̹t̚k͈a̠ɾa̠k̚t͡ɕ͈iɭ', 'txy~Ut@.ka_u&ra_u&k.t@xy~iL', 'ts\\V_Ot_}ka_-4a_-k_}ts\\il`'),
    ('t͡ɕʌ̹pɕ͈i', 'txy~Up@xy~i', 'ts\\V_Ops\\i'),
    ('ˈt͡ɕɘ(ː)mpʰo̞', 'txy~I_^mph~o', '"ts\\@\\(:)mp_ho_o'),
    ('t͡ɕʌ̹ŋɕʰinɰiɦa̠k̚', 'txy~Uqxy~h~inWihh~a_u&k.', 'ts\\V_ONs\\_hinM\\ih\\a_-k_}'),
    ('t͡ɕʌ̹ŋsʰa̠ŋβwe̞da̠m', 'txy~Uqsh~a_u&qVweda_u&m', 'ts\\V_ONs_ha_-NBwe_oda_-m'),
    ('ip̚p͈ʌ̹p̚t͡ɕ͈a̠', 'ip@.pUp.t@xy~a_u&', 'ip_}pV_Op_}ts\\a_-'),
    ('(ʔ)evoˈlut͡sja', "'evolu^tsya", '(?)evo"lutsja'),
    ('adʁiˈχal', 'adGiHa^l', 'adRi"Xal'),
    ('k͈o̞ms͈o̞mo̞ɭsʰɯkxɯ-na̠-a̠muɾe̞', 'k@oms@omoLsh~OkHO=-na_u&=-a_u&mure', 'ko_omso_omo_ol`s_hMkxM-na_--a_-mu4e_o'),
    ('ɸʷo̞', 'Fw~o', 'p\\_wo_o'),
    ('kxɯnsʰo̞ɾit͡ɕʰida̠', 'kHOnsh~oritxy~h~ida_u&', 'kxMns_ho_o4its\\_hida_-'),
    ('kxɯʎʎikʰa̠da̠', 'kHOly~ly~ikh~a_u&da_u&', 'kxMLLik_ha_-da_-'),
    ('ɔ̂ːi̯.on', 'o$_i@on', 'O_F:i_^.on'),
    ('kuɾl', 'kurl', 'ku4l'),
)
#: Word, syllables, their number, IPA (none where a character has no sound).
SYLLABLES = (
    ('ayu$ve^ydU', 'a - yu$ - ve^y - dU', 4, 'ajɹvˈejdə'),
    ('kUba^llU', 'kU - ba^l - lU', 3, 'kəbˈallə'),
    ('fOla^sOfi', 'fO - la^ - sO - fi', 4, 'fʊlˈasʊfi'),
    ('fOla^sOfirmja', 'fO - la^ - sO - firm - ja', 5, 'fʊlˈasʊfirmʒa'),
    ("'lKadami", "'l - Ka - da - mi", 4, 'ʔlqadami'),
    ("'ldjaryu", "'l - djar - yu", 3, 'ʔldʒarju'),
    ("'lttazalludju", "'lt - ta - zal - lu - dju", 5, 'ʔlttazalludʒu'),
    ("'l'alw'hh~i", "'l - 'alw' - hh~i", 3, 'ʔlʔalwʔhʰi'),
    ('sUfI^stUkeItEdanjdxwa', 'sU - fI^ - stU - keI - tE - danjd - xwa', 7, 'səfˈɪstəkeɪtɛdanʒdʃwa'),
    ('AmplIfaydrai', 'Amp - lI - fayd - rai', 4, 'æmplɪfajdrai'),
    ('briqketzwaqlOmptzwa', 'briq - ketz - waq - lOmpt - zwa', 5, 'briŋketzwaŋlʊmptzwa'),
    ('AmplIfaydz', 'Amp - lI - faydz', 3, 'æmplɪfajdz'),
    ('A&_^mplIfaydzoltxahasntayCwa', 'A&_^mp - lI - fayd - zol - txa - hasn - tayC - wa', 8, 'æ̰ˈːmplɪfajdzoltʃahasntajðwa'),
    ("'lddarr'dj'ti", "'ld - darr'dj' - ti", 3, 'ʔlddarrʔdʒʔti'),
    ("'lK'Qida_ti", "'lK' - Qi - da_ - ti", 4, 'ʔlqʔʕidaːti'),
    ("'lGu_lfu", "'l - Gu_l - fu", 3, 'ʔlʁuːlfu'),
    ("galf'u", "galf - 'u", 2, 'galfʔu'),
    ("galf'u'", "galf - 'u'", 2, 'galfʔuʔ'),
    ("galf'u'l", "galf - 'u'l", 2, 'galfʔuʔl'),
    ('gaialfsz', 'gai - alfsz', 2, 'gaialfsz'),
    ('gaiaoilfst', 'gai - ao - ilfst', 3, 'gaiaoilfst'),
    ('greIdAotxs', 'greI - dAotxs', 2, 'greɪdæotʃs'),
    ('prvst', 'prvst', 1, 'prvst'),
    ("'uHtQ~ubu_tQ~", "'uH - tQ~u - bu_tQ~", 3, 'ʔuχtˤubuːtˤ'),
    ("kahru_dQ~aw'iyy", "ka - hru_ - dQ~aw' - iyy", 4, 'kahruːdˤawʔijj'),
    ('kahru_manziliyy', 'ka - hru_ - man - zi - liyy', 5, 'kahruːmanzilijj'),
    ('ladjdja', 'ladj - dja', 2, 'ladʒdʒa'),
    ('ko_nsarva_tuwa_r', 'ko_n - sar - va_ - tu - wa_r', 5, 'koːnsarvaːtuwaːr'),
    ('marciya', 'mar - ci - ya', 3, 'marθija'),
    ('masQ~sQ~a_sQ~', 'masQ~ - sQ~a_sQ~', 2, 'masˤsˤaːsˤ'),
    ('mudjrim', 'mudj - rim', 2, 'mudʒrim'),
    ('maHh~alliyy', 'ma - Hh~al - liyy', 3, 'maχʰallijj'),
    ('kIt~a_^b', 'kI - t~a_^b', 2, 'kɪt̪aˈːb'),
    ('KusQ~rumill', 'KusQ~ - ru - mill', 3, 'qusˤrumill'),
    ('KasQ~riyya', 'KasQ~ - riy - ya', 3, 'qasˤrijja'),
    ('KantQ~u_r', 'Kan - tQ~u_r', 2, 'qantˤuːr'),
    ('Qidjrim', 'Qidj - rim', 2, 'ʕidʒrim'),
    ('mawrid', 'maw - rid', 2, 'mawrid'),
    ("'lssamaka_tu 'lbuhh~ayri_a_tu", "'ls - sa - ma - ka_ - tu 'l - bu - hh~ay - ri_ - a_ - tu", 10, None),
    ("'lliK'hh~u", "'l - liK' - hh~u", 3, 'ʔlliqʔhʰu'),
    ("'lQi_'da_tu", "'l - Qi_' - da_ - tu", 4, 'ʔlʕiːʔdaːtu'),
    ('u$U^nIq', 'u$U^ - nIq', 2, 'ɹˈənɪŋ'),
    ('bu$U^nIq', 'bu$U^ - nIq', 2, 'bɹˈənɪŋ'),
    ('bou$U^nIq', 'bou$ - U^ - nIq', 3, 'boɹˈənɪŋ'),
    ('sa^kOu$', 'sa^ - kOu$', 2, 'sˈakʊɹ'),
    ('xakiu$U', 'xa - kiu$ - U', 3, 'ʃakiɹə'),
    ('ske^ytbou$dIq', 'ske^yt - bou$ - dIq', 3, 'skˈejtboɹdɪŋ'),
)
#: Word, simplified key, mass; the heaviest first.
KEYS = (
    ('by~oph~am', 'by~oph~am', 1.0),
    ('by~oph~am', 'by~opam', 0.6196),
    ('by~oph~am', 'by~aph~am', 0.572),
    ('by~oph~am', 'pyopham', 0.4293),
    ('by~oph~am', 'by~apam', 0.3342),
    ('by~oph~am', 'pyapham', 0.2153),
    ('by~oph~am', 'by~ph~m', 0.144),
    ('by~oph~am', 'by~pm', 0.0489),
    ('by~oph~am', 'pyphm', 0.0013),
    ('greIdAotxs', 'greIdAotxs', 1.0),
    ('greIdAotxs', 'greidotxs', 0.7147),
    ('greIdAotxs', 'gradatxs', 0.572),
    ('greIdAotxs', 'kreItAotxs', 0.4293),
    ('greIdAotxs', 'kreitotxs', 0.2867),
    ('greIdAotxs', 'kratatxs', 0.2153),
    ('greIdAotxs', 'grdtxs', 0.144),
    ('greIdAotxs', 'krttxs', 0.0013),
    ("Kad~Q~a_^'", "Kad~Q~a_^'", 1.0),
    ("Kad~Q~a_^'", "Kad~Q~a'", 0.7147),
    ("Kad~Q~a_^'", "Kad~Q~a^'", 0.6196),
    ("Kad~Q~a_^'", "Kata_^'", 0.4293),
    ("Kad~Q~a_^'", "Kata'", 0.2867),
    ("Kad~Q~a_^'", "Kata^'", 0.2391),
    ("Kad~Q~a_^'", "Kd~Q~'", 0.144),
    ("Kad~Q~a_^'", "Kt'", 0.0013),
    ('ba+_h~e-', 'ba+_h~e-', 1.0),
    ('ba+_h~e-', 'bah~e', 0.7147),
    ('ba+_h~e-', 'ba+_e-', 0.6196),
    ('ba+_h~e-', 'ba+h~e-', 0.6196),
    ('ba+_h~e-', 'ba_h~e', 0.6196),
    ('ba+_h~e-', 'bah~a', 0.572),
    ('ba+_h~e-', 'bae', 0.4293),
    ('ba+_h~e-', 'pa+_he-', 0.4293),
    ('ba+_h~e-', 'ba+e-', 0.3659),
    ('ba+_h~e-', 'ba_e', 0.3659),
    ('ba+_h~e-', 'baa', 0.3342),
    ('ba+_h~e-', 'pahe', 0.2867),
    ('ba+_h~e-', 'pa+he-', 0.2391),
    ('ba+_h~e-', 'pa_he', 0.2391),
    ('ba+_h~e-', 'paha', 0.2153),
    ('ba+_h~e-', 'bh~', 0.144),
    ('ba+_h~e-', 'b', 0.0489),
    ('ba+_h~e-', 'ph', 0.0013),
    ('na/\\q', 'na/\\q', 1.0),
    ('na/\\q', 'n/\\q', 0.0015),
    ('purchase', 'purchase', 1.0),
    ('purchase', 'parchasa', 0.5008),
    ('purchase', 'prchs', 0.0015),
)
# fmt: on
# End of fixed values.
