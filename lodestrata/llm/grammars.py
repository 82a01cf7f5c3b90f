"""Regular statement grammars of the languages, over token classes.

Brackets are reduced before a grammar is applied: ``P`` is a parenthesised
group, ``K`` one in square brackets, ``Z`` one in braces.  The other letters are
the token classes that the lexer of the language emits:
i name, n number or constant, s string, ``.`` member dot, m comma, t end of a
statement, o colon, q question mark, d plus or minus, c star or ampersand,
b another binary operator, l r angle brackets, u increment, h prefix operator,
e ``=``, E compound assignment, g ``=>``, y ``->``, D ``::``, z ``...`` or ``..``,
@ annotation sign, x ``#``, j a contextual word, and keywords by language.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    """keywords: word -> class.  blocks: grammar of one statement.  The rest: what groups may hold besides."""

    keywords: dict[str, str]
    statement: str
    paren: str
    bracket: str
    brace: str
    top: str | None = None
    fields: str | None = None
    params: str | None = None
    #: Classes that go on with a statement after a braced group.
    goes_on: str = ""
    #: What, when it ends in a braced group, is never a whole statement.
    holds: str | None = None
    #: Classes with which a file can begin; None: any statement's.
    begins: str | None = None
    #: Whether a braced group may hold statements.
    blocks: bool = True
    operators: dict[str, str] = field(default_factory=dict)


def _words(**groups: str) -> dict[str, str]:
    return {w: letter for letter, words in groups.items() for w in words.split()}


def _expression(primary: str, prefix: str, suffix: str, binary: str, ternary: bool = True) -> str:
    unit = f"({prefix})*({primary})({suffix})*"
    plain = f"{unit}(({binary}){unit})*"
    return f"{plain}(q {plain} o {plain})*" if ternary else plain


def _listed(item: str, end: str = "m?") -> str:
    return f"(({item})(m({item}))*{end})?"


# --- JavaScript and TypeScript -----------------------------------------------------

_JS_WORDS = _words(
    F="function", C="class", N="new typeof void delete await yield", R="return throw", V="var let const", G="if while for switch with catch", H="else do try finally",
    k="break continue debugger", I="import", X="export", Y="default", T="extends", B="case", b="in instanceof of", n="true false null undefined this super", M="async static",
)


def _javascript(typed: bool) -> Language:
    generic = "(l[isnNPKZmlrb.oqgcTF]*r)?" if typed else ""
    # a type: names with arguments, literals, functions, arrays, unions
    atom = f"([NFh])*([isn]|K|Z|P(g[isn])?)(\\.i)*{generic}K*" if typed else ""
    kind = f"{atom}([bcqo]{atom})*" if typed else ""
    note = f"(q?o {kind})?" if typed else ""
    primary = f"[insPKZ]|M?Fc?i?{generic}P{note}Z|Ci?{generic}(T i(\\.i)*{generic}P?)?(W i{generic}(mi{generic})*)?Z|IP" if typed else "[insPKZ]|M?Fc?i?PZ|Ci?(T i(\\.i)*P?)?Z|IP"
    arrow = f"M?[iP]g|M?P o {atom} g" if typed else "M?[iP]g"
    suffix = f"P|K|s|\\.[iPK]|u{'|h|A ' + atom + '|l[isnNPKZmb.]*r(P|s)' if typed else ''}"
    e = _expression(primary, f"N|h|d|u|{arrow}{'|l[isn]r' if typed else ''}", suffix, "b|d|c|l|r|e|E")
    several = f"{e}(m{e})*"
    declared = f"[iKZ]{'h?' if typed else ''}{note}(e{e})?"
    variables = f"V{declared}(m{declared})*"
    function = f"M?Fc?i{generic}P{note}Z?"
    clazz = f"M*C i?{generic}(T i(\\.i)*{generic}P?)?{'(T i' + generic + '(mi' + generic + ')*)?' if typed else ''}Z"
    member = f"(@i(\\.i)*P?)*M*c?[isnK]q?{generic}P{note}Z" + (f"|(@i(\\.i)*P?)*M*c?[isnK]q?{generic}P{note}t|M*[isnK][qh]?{note}(e{e})?[tm]?|M*P{note}t|M*K{note}[tm]?|N?P{note}[tm]" if typed else "|M*[isnK](e" + e + ")?t?")
    simple = f"{several}|{variables}|R({several})?|k i?"
    typed_items = f"|(X|M)*W i{generic}(T i{generic}(mi{generic})*)?Z t?|(X|M)*W i{generic}e{kind}t?|(X|M)*W[is]Z|M*{variables}t?|M*{function}t?" if typed else ""
    statement = (
        f"(i o)?(B{e}o|Yo)*(t|({simple})t?|(@i(\\.i)*P?)*(XY?)?({function}|{clazz})t?|X{variables}t?|XY{several}t?|X(N)?Z(js)?t?|Xc(ji)?jst?"
        f"|I(N)?((i|Z|cji)(m(Z|cji))?j)?s t?|((GP?|H)Z?)+({simple})?t?|Z t?|{member}{typed_items})?"
    )
    item = f"z{e}|[isnK]o{e}|i(e{e})?|iji|Yji|M*c?[isnK]PZ" + (f"|M*c?[isnK]{generic}P{note}Z|N?i(ji)?" if typed else "")
    parameter = (f"(@iP?)*M*z?[iZKn]{note}(e{e})?|z?{e}|{kind}" if typed else f"z?{e}")
    paren = _listed(parameter) + f"|({variables}|{several})?t({several})?t({several})?t?|V[iKZ](b){e}"
    bracket = f"m*(z?{e}(m+z?{e})*m*)?" + (f"|i o {kind}|i b {kind}|{_listed(kind)}" if typed else "")
    words = dict(_JS_WORDS)
    if typed:
        words |= _words(W="interface enum namespace", M="async static public private protected readonly abstract declare override", N="new typeof void delete await yield keyof infer unique", A="as satisfies", T="extends implements")
    return Language(words, statement, paren, bracket, _listed(item) + (f"|({member}|{typed_item_list(kind, note)})*" if typed else ""), goes_on="HGjmt.boqedclrEhPKTAg" if typed else "HGjmt.boqedclrEPKg", operators={})


def typed_item_list(kind: str, note: str) -> str:
    return f"[is](e[snd]+)?m?"


# --- Java ------------------------------------------------------------------------------


def _java() -> Language:
    words = _words(
        C="class interface enum record", M="public private protected static final abstract synchronized volatile transient native strictfp sealed", G="if while for switch catch", H="else do try finally", R="return throw yield",
        A="assert", k="break continue", N="new", I="import package", T="extends implements throws permits", B="case", Y="default", b="instanceof", n="true false null this super",
    )
    generic = "(l[ilrmqTKc.@]*r)?"
    kind = f"i{generic}(\\.i{generic})*K*"
    annotations = "(@i(\\.i)*P?)*"
    e = _expression(f"[insPZ]|N{kind}(PZ?|K*Z?)|i K+\\.C|{kind}Di|[iP]yZ|GPZ", "P|h|d|u|[iP]y", f"P|K|\\.(i|n|C|N i{generic}PZ?)|\\.l[ilrm.]*r i|u|D[iN]|l[im.K]*r D N", "b|d|c|l|r|e|E")
    several = f"{e}(m{e})*"
    local = f"({annotations}M)*{annotations}{kind}iK*(e{e})?(m iK*(e{e})?)*"
    method = f"({annotations}M)*{annotations}Y?(l[ilrmqTc.]*r)?({kind})?i P K*(T{kind}(m{kind})*)?(Y {e})?(Z|t)"
    clazz = f"({annotations}M)*{annotations}@?C i(l[ilrmqTc.]*r)?P?(T{kind}(m{kind})*)*Z t?"
    simple = f"{several}|{local}|R({several})?|k i?|A{e}(o{e})?"
    statement = f"(i o)?(B({e}(m{e})*)(o|y)|Y(o|y))*(t|({simple})t|{method}|{clazz}|I M?i(\\.(i|c))*t|((GP|H)P?Z?|M P Z)+(({simple})t)?t?|M?Z t?|{annotations}I i(\\.i)*t)?"
    parameter = f"({annotations}M)*{annotations}{kind}(z)?(i|n)K*|{e}|{kind}(c{kind})*"
    paren = _listed(parameter, "") + f"|({local}|{several})?t({several})?t({several})?t?|({annotations}M)*{kind}i o{e}|M*{kind}(b{kind})*i|({local}t?)+|i e({e})(m i e {e})*"
    bracket = f"({e})?"
    brace = _listed(e) + f"|({annotations}iP?Z?(m{annotations}iP?Z?)*m?)?"
    return Language(words, statement, paren, bracket, brace, goes_on="HGmt.Pboqdclr", begins="IM@CTt")


# --- C -----------------------------------------------------------------------------------


def _c() -> Language:
    words = _words(
        W="int char short long float double void signed unsigned _Bool bool", M="static const volatile extern inline register restrict auto _Noreturn _Thread_local __inline __restrict", S="struct union enum", Y="typedef",
        G="if while for switch", H="else do", R="return goto", k="break continue", B="case", T="default", N="sizeof _Alignof", n="NULL true false",
    )
    kind = "[MW]*(W|i|S i|S i?Z)[MW]*"
    e = _expression("[in]|s(s|i)*|P|Z", "h|d|c|u|P|N", "P|K|\\.i|y i|u|Z", "b|d|c|l|r|e|E")
    several = f"{e}(m{e})*"
    name = f"(c M*)*(i|P)(K|P)*(o{e})?(e{e})?"
    local = f"Y?{kind}({name}(m{name})*)?"
    simple = f"{several}|{local}|R({e})?|k"
    statement = f"(i o)?(B{e}(z{e})?o|To)*(t|({simple})t|M*{kind}(cM*)*(i|P)P(i P?)*(Z|t)|M*iPZ|((GP|H)Z?)+(({simple})t)?t?|Z t?|M s Z|i P t?|Y?S i?Z({name}(m{name})*)?t)?"
    parameter = f"{kind}(cM*)*(i|P)?(K|P)*|z|{e}|{kind}(cM*)*P?K*"
    paren = _listed(parameter, "") + f"|({local}|{several})?t({several})?t({several})?t?|Z"
    item = f"(\\.i|K)+e{e}|{e}"
    return Language(words, statement, paren, f"M?({e})?", _listed(item) + f"|{_listed(f'i(e{e})?')}", goes_on="HGmte.", holds=r"[YM]*Si?Z|.*eZ", begins="YSMWi$")


# --- Go -----------------------------------------------------------------------------------


def _go() -> Language:
    words = _words(
        F="func", V="var const", Q="type", p="package", I="import", C="struct interface", a="map chan", G="if for switch select", H="else", R="return", k="break continue goto fallthrough", B="case", Y="default", N="go defer", A="range", n="true false nil iota",
    )
    kind = "(c|K|a K?|y|z)*(i(\\.i)?K?|CZ|P|FP(i(\\.i)?|P|(c|K)+i(\\.i)?|C Z)?)"
    e = _expression(f"[ins]|P|FP({kind})?Z|(K|a K|c)+{kind}|CZ|Z", "h|d|c|y|A", "P|K|\\.(i|P|Q)|Z|\\.P", "b|d|c|l|r|y", False)
    several = f"{e}(m{e})*"
    simple = f"{several}((e|E|J)({several}))?|{several}u|{several}y{e}|{several}"
    declared = f"i(mi)*({kind})?(e{several})?"
    statement = (
        f"(i o t?)?(B({several}|{kind}(m{kind})*|{simple})o t?|Y o t?)*(t|({simple})t?|N{e}t?|R({several})?t?|k i?t?|V({declared}|P)t?|Q(iK?e?{kind}|P)t?|p i t|I((i|\\.)?s|P)t?"
        f"|FP?iK?P({kind})?Z?t?|(G({simple})?(j({simple})?)*(J)?Z|H)+(Z)?t?|(G({simple})?(j({simple})?)*Z H?)+Z?t?|Z t?)?"
    )
    parameter = f"(i(mi)*)?z?{kind}|i|z?{kind}"
    params = f"({_listed(parameter)})t?|({_listed(parameter)})"
    spec = f"({declared}|iK?e?{kind}|(i|\\.)?s)?"
    paren = f"{_listed(f'{e}z?|{kind}')}|(t?{spec}(t{spec})*t?)"
    fields = f"((i(mi)*{kind}|c?i(\\.i)?K?|iP({kind})?|h?{kind}((b|c){kind})*)(s)?)?t?"
    item = f"({e}o)?{e}"
    return Language(words, statement, paren, f"({e})?o?({e})?o?({e})?|z|i(mi)*{kind}(m i {kind})*|{_listed(kind)}", f"t?{_listed(item)}t?", fields=fields, params=params, goes_on="HmtPK.oZeEJblrdcs", begins="p")


# --- Rust -----------------------------------------------------------------------------------


def _rust() -> Language:
    words = _words(
        F="fn", L="let", M="mut ref dyn move box", V="pub unsafe async extern default", C="const static", S="struct enum union trait mod", Y="type", I="impl", U="use", R="return break", k="continue",
        G="if while match for", H="else loop", N="in", A="as", W="where", n="true false", i="self Self super crate",
    )
    generic = "(l[ilrmoTecbKPnMyFDzqCxIdh.]*r)"
    path = f"(D)?(i|l[ilrmADnckKP]*r)(D(i|{generic}))*{generic}?"
    kind = f"(c|b|T|M|C|I|q|V)*({path}P?(y{path})?|K|P|F P(y [ciPKT]+)?|h)((d)(q)?(T|{path}P?))*"
    loop = "(T o)?"
    e = _expression(
        f"[ns]|{path}h[PKZ]|{path}Z?|P|K|{loop}(V)?Z|{loop}GZ|z|R|k",
        "h|d|c|b|M|(M?b b?|M?(b[iMcmKPonzqTl DxrZ]*b))|R(T)?|z", "P|K|\\.(i(D l[ilrmcKPTn]*r)?|n|V)|q|z|A([cM])*" + path, "b|d|c|l|r|e|E|z|A([cMC])*", False,
    )
    cond = f"(L{'[iPKZnscMmbDz.@dlr]+'}e)?{e}((b|d|c)(L[iPKZnscMmbDz.@dlr]+e)?{e})*"
    pattern = "[iPKZnscMmbDz@dlr.]+"
    tail = f"(G{cond}Z|G{pattern}N{e}Z|H)"
    flow = f"{loop}(G({cond}|{pattern}N{e})Z|H Z)(H(G({cond}))?Z)*"
    attribute = "(x h?K)*"
    whole = f"({e}|{flow})"
    let = f"L{pattern}(o{kind})?(e({whole}((d|b|c|l|r|\\.i|q|P|K|A){e})*)(H Z)?)?"
    where = "(W[ilrmoTedbcDPFy.hIqKMC]+)?"
    visible = "(V(P|s)?)*"
    function = f"{visible}C?{visible}F i{generic}?P(y{kind})?{where}(Z|t)"
    item = (
        f"{function}|{visible}S i{generic}?(o[idTlrmDqP]+)?{where}(Z|P{where}t|t)t?|{visible}Y i{generic}?(o[idTDlr]+)?(e{kind})?t|{visible}C M?i o{kind}(e{e})?t|{visible}U D?[iDZcA]+t|V?I{generic}?h?{kind}(G{kind})?{where}Z"
        f"|V s?Z|i h i?[PKZ]t?|{visible}V i i t"
    )
    statement = f"({attribute})((t|({let})t|({e})t?|{flow}(\\.i|P|K|q|b{e}|d{e}|A i)*t?|R({flow})t?|{item}))?"
    parameter = f"({attribute})(M|T|b)*{pattern}o{kind}|(b|T|M|c)*i|{e}|{kind}|z|{flow}"
    paren = _listed(f"{parameter}|({e}(e|E){flow})")
    bracket = _listed(f"{e}|{flow}") + f"|{kind}t{e}|{e}t{e}|i[Pe]*(s|n|i|P|m)*|{kind}"
    arm = f"({attribute})b?{pattern}(G{cond})?g({e}|{flow}|Z|R|k|t)m?"
    field = f"({attribute}){visible}[in]o({kind})|({attribute})i(P|Z)?(e{e})?|i(o({e}|{flow}))?|z({e})?"
    return Language(words, statement, paren, bracket, _listed(field) + f"|({arm}(m?{arm})*)?m?|{_listed('i(DZ|D[iD]+Z?|A i)?|c')}", goes_on="Ht.qmPbdecHglrAK")


# --- Python -----------------------------------------------------------------------------------


def _python() -> Language:
    words = _words(
        D="def", C="class", G="if", W="while elif with match", H="else", T="try finally", X="except", A="async", F="for", N="in", R="return raise yield del assert", I="import", f="from", a="as", k="pass break continue", L="lambda", n="None True False", h="not", b="and or is", O="global nonlocal", w="await",
    )
    words.pop("match")
    # the parameters of a lambda, loosely: names, stars, defaults
    args = "[icmebnsPKZ.hd]*"
    unit = f"(h|d|w|L{args}o)*([inPKZ]|s+|z)(\\.i|P|K)*"
    plain = f"{unit}((b h?|hN|N|d|c|l|r|@|E){unit})*"
    e = f"{plain}(G{plain}H{plain})*"
    star = f"c?{e}"
    several = f"{star}(m{star})*m?"
    value = f"({several}|R(f?{several})?)"
    for_part = f"A?F{several}"
    target = "c?[iPK](\\.i|P|K)*"
    targets = f"{target}(m{target})*m?"
    simple = f"({several}|({targets}e)+{value}|{target}(E{value}|o{e}(e{value})?)|iE{value}|R({several})?(f{e})?|Rf{e}|k|O i(mi)*|I i(\\.i)*(a i)?(m i(\\.i)*(a i)?)*|f[\\.z]*(i(\\.i)*)?I(c|P|i(a i)?(m i(a i)?)*))"
    body = f"({simple}(t{simple})*)?"
    statement = f"({simple}|@{e}|A?D i K?P(y{e})?o{body}|C iK?P?o{body}|[GW]{e}(a{e})?(m{e}(a{e})?)*o{body}|AW{e}(a{e})?o{body}|{for_part}o{body}|[HT]o{body}|X(c?{e}(m{e})*(a i)?)?o{body}|J|j)?"
    comprehension = f"({for_part}(G{plain})*)+"
    item = f"c?{e}(e{e}|oE?{e})?|i o{e}(e{e})?|c|b|c i(o{e})?"
    paren = f"({_listed(item)})|{e}{comprehension}|R(f?{several})?|{_listed('i(a i)?')}|{_listed(e + '(a ' + e + ')?')}"
    slice_ = f"({e})?(o({e})?(o({e})?)?)?"
    bracket = f"{_listed(slice_ + '|' + star)}|{e}{comprehension}"
    brace = f"{_listed(e + 'o' + e + '|c' + e)}|{_listed(star)}|{e}(o{e})?{comprehension}"
    return Language(words, statement, paren, bracket, brace, blocks=False)


# --- data -----------------------------------------------------------------------------------

_TOML_KEY = "[insv](\\.[insv])*"
_TOML_VALUE = "[svKZ]"
_JSON_VALUE = "[svKZ]"

LANGUAGES: dict[str, Language] = {
    "js": _javascript(False),
    "ts": _javascript(True),
    "java": _java(),
    "c": _c(),
    "go": _go(),
    "rs": _rust(),
    "py": _python(),
    "toml": Language({}, f"({_TOML_KEY}e{_TOML_VALUE}|K)?t?", "", f"{_TOML_KEY}|K|{_listed(_TOML_VALUE)}", f"({_TOML_KEY}e{_TOML_VALUE}(m{_TOML_KEY}e{_TOML_VALUE})*)?", blocks=False),
    "json": Language({}, _JSON_VALUE, "", f"({_JSON_VALUE}(m{_JSON_VALUE})*)?", f"(so{_JSON_VALUE}(mso{_JSON_VALUE})*)?", top=_JSON_VALUE, blocks=False, begins="svKZ"),
}
LANGUAGES["h"] = LANGUAGES["c"]
