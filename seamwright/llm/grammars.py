"""Grammars of the languages that are checked, over the token kinds of ``lexers``.

The rules follow the public language definitions.  They are written without left
recursion; where one definition needs context (arrow parameters against a bracketed
expression, types against comparisons) the alternatives simply stay in the derivative
until a token decides between them.
"""

from __future__ import annotations

from functools import lru_cache

from .derive import Grammar

# Reserved and contextual words of the languages.
JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for "
    "function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
JS_CONTEXTUAL = frozenset(
    "abstract accessor as asserts assert async await declare from get global implements infer interface is keyof let "
    "meta module namespace of out override private protected public readonly require satisfies set static target type "
    "unique using yield".split()
)
PY_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield".split()
)
PY_SOFT = frozenset("match case type _".split())

JSON_RULES = r"""
text: value
value: 'STR' | 'NUM' | 'true' | 'false' | 'null' | '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']'
pair: 'STR' ':' value
"""

TOML_RULES = r"""
text: 'NL'* (line ('NL'+ line)* 'NL'*)?
line: '[' key ']' | '[[' key ']]' | key '=' value
key: KEY ('.' KEY)*
value: 'STR' | 'ATOM' | '[' 'NL'* (value 'NL'* (',' 'NL'* value 'NL'*)* (',' 'NL'*)?)? ']' | '{' (key '=' value (',' key '=' value)*)? '}'
"""

PY_RULES = r"""
file: stmt*
stmt: simple (';' simple)* ';'? 'NEWLINE' | compound
simple: assignment | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)*
   | 'del' deltarget (',' deltarget)* ','? | 'pass' | 'break' | 'continue' | 'assert' expr (',' expr)? | importing
   | 'type' NAME tparams? '=' expr
importing: 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)*
   | 'from' ((dots? dotted) | dots) 'import' ('*' | importlist | '(' importlist ','? ')')
importlist: NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
dots: ('.' | '...')+
dotted: NAME ('.' NAME)*
assignment: exprs | yielding | (startargets '=')+ (exprs | yielding) | single AUG (exprs | yielding) | anntarget ':' expr ('=' (exprs | yielding))?
anntarget: NAME | '(' single ')' | access
single: NAME | access | '(' single ')'
startargets: startarget (',' startarget)* ','?
startarget: '*'? target
target: NAME | access | '(' startargets? ')' | '[' startargets? ']'
access: base (call* (attr | index))+
deltarget: NAME | access | '(' (deltarget (',' deltarget)* ','?)? ')' | '[' (deltarget (',' deltarget)* ','?)? ']'
base: atom | 'await' atom
call: '(' args? ')'
attr: '.' NAME
index: '[' slices ']'
yielding: 'yield' ('from' expr | exprs)?
compound: decorator* (fndef | classdef) | ifst | whilest | forst | tryst | withst | 'async' (forst | withst) | matchst
decorator: '@' named 'NEWLINE'
fndef: 'async'? 'def' NAME tparams? '(' params? ')' ('->' expr)? ':' block
classdef: 'class' NAME tparams? ('(' args? ')')? ':' block
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: NAME (':' expr)? ('=' expr)? | '*' NAME ('=' starexpr)? | '**' NAME ('=' expr)?
block: simple (';' simple)* ';'? 'NEWLINE' | 'NEWLINE' 'INDENT' stmt stmt* 'DEDENT'
ifst: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
whilest: 'while' named ':' block ('else' ':' block)?
forst: 'for' startargets 'in' exprs ':' block ('else' ':' block)?
tryst: 'try' ':' block ('finally' ':' block | (handler handler* | grouphandler grouphandler*) ('else' ':' block)? ('finally' ':' block)?)
handler: 'except' (expr ('as' NAME)?)? ':' block
grouphandler: 'except' '*' expr ('as' NAME)? ':' block
withst: 'with' (item (',' item)* | '(' item (',' item)* ','? ')') ':' block
item: expr ('as' startarget)?
matchst: 'match' subject ':' 'NEWLINE' 'INDENT' caseblock caseblock* 'DEDENT'
subject: namedstar (',' namedstar)* ','?
caseblock: 'case' patterns ('if' named)? ':' block
patterns: maybestar (',' maybestar)* ','?
maybestar: '*' NAME | aspattern
aspattern: orpattern ('as' NAME)?
orpattern: closed ('|' closed)*
closed: signed (('+' | '-') 'NUM')? | 'STR' 'STR'* | 'None' | 'True' | 'False' | NAME ('.' NAME)* ('(' (patarg (',' patarg)* ','?)? ')')?
   | '(' (maybestar (',' maybestar)* ','?)? ')' | '[' (maybestar (',' maybestar)* ','?)? ']' | '{' (mapitem (',' mapitem)* ','?)? '}'
signed: '-'? 'NUM'
patarg: (NAME '=')? aspattern
mapitem: '**' NAME | (signed (('+' | '-') 'NUM')? | 'STR' 'STR'* | 'None' | 'True' | 'False' | NAME '.' NAME ('.' NAME)*) ':' aspattern
params: plain (',' plain)* (',' '/' (',' plain)*)? (',' ('/' ',')? defaulted)? ','?
   | plain (',' plain)* ',' '/' ',' defaulted ','? | defaulted ','? | plain (',' plain)* (',' '/' (',' plain)*)? ',' starpart ','? | starpart ','?
plain: NAME (':' expr)?
default: NAME (':' expr)? '=' expr
defaulted: default (',' default)* (',' '/' (',' default)*)? (',' starpart)?
starpart: '*' NAME (':' starexpr)? (',' NAME (':' expr)? ('=' expr)?)* (',' kwpart)? | '*' (',' NAME (':' expr)? ('=' expr)?)+ (',' kwpart)? | kwpart
kwpart: '**' NAME (':' expr)?
lparams: lplain (',' lplain)* (',' '/' (',' lplain)*)? (',' ('/' ',')? ldefaulted)? ','?
   | lplain (',' lplain)* ',' '/' ',' ldefaulted ','? | ldefaulted ','? | lplain (',' lplain)* (',' '/' (',' lplain)*)? ',' lstarpart ','? | lstarpart ','?
lplain: NAME
ldefault: NAME '=' expr
ldefaulted: ldefault (',' ldefault)* (',' '/' (',' ldefault)*)? (',' lstarpart)?
lstarpart: '*' NAME (',' NAME ('=' expr)?)* (',' '**' NAME)? | '*' (',' NAME ('=' expr)?)+ (',' '**' NAME)? | '**' NAME
exprs: starexpr (',' starexpr)* ','?
starexpr: expr | '*' bitor
named: NAME ':=' expr | expr
namedstar: named | '*' bitor
expr: disj ('if' disj 'else' expr)? | 'lambda' lparams? ':' expr
disj: conj ('or' conj)*
conj: inv ('and' inv)*
inv: 'not'* comparison
comparison: bitor (COMP bitor | 'not' 'in' bitor | 'is' 'not'? bitor)*
bitor: unary (BINOP unary)*
unary: SIGN* power
power: 'await'? primary ('**' unary)?
primary: atom (call | attr | index)*
slices: slice (',' slice)* ','?
slice: expr? ':' expr? (':' expr?)? | named | '*' bitor
atom: NAME | 'NUM' | 'STR' 'STR'* | 'None' | 'True' | 'False' | '...' | '(' (yielding | namedstar (',' namedstar)* ','? | named comp)? ')'
   | '[' (namedstar (',' namedstar)* ','? | named comp)? ']' | '{' (dictitem (',' dictitem)* ','? | dictpair comp | namedstar (',' namedstar)* ','? | named comp)? '}'
dictitem: dictpair | '**' bitor
dictpair: expr ':' expr
comp: compfor compfor*
compfor: 'async'? 'for' startargets 'in' disj ('if' disj)*
args: named comp | positional (',' positional)* (',' keywords)? ','? | keywords ','?
positional: named | '*' expr
keywords: keyword (',' keyword)*
keyword: NAME '=' expr | '*' expr | '**' expr
field: (exprs | yielding) '='?
"""

JS_RULES = r"""
program: item*
item: stmt | importing | exporting
stmt: block | vardecl semi | fndecl | classdecl | ';' | exprnb semi
   | 'if' '(' expr ')' stmt ('else' stmt)? | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' expr ')' stmt
   | 'do' stmt 'while' '(' expr ')' (';' | 'ASI')? | 'continue' ID? semi | 'break' ID? semi | 'return' expr? semi | 'throw' expr semi
   | 'switch' '(' expr ')' '{' caseclause* (defaultclause caseclause*)? '}' | 'try' block (catching finallyst? | finallyst)
   | 'with' '(' expr ')' stmt | 'debugger' semi | ID ':' stmt | tsstmt
block: '{' stmt* '}'
caseclause: 'case' expr ':' stmt*
defaultclause: 'default' ':' stmt*
catching: 'catch' ('(' bind typeann? ')')? block
finallyst: 'finally' block
semi: ';' | 'ASI'
forhead: vardecl? ';' expr? ';' expr? | expr ';' expr? ';' expr? | ('var' | 'let' | 'const' | 'await'? 'using') bind ('of' assign | 'in' expr) | lhs ('of' assign | 'in' expr)
vardecl: ('var' | 'let' | 'const' | 'await'? 'using') binding (',' binding)*
binding: bind tsbang? typeann? ('=' assign)?
bind: ID | '{' (bprop (',' bprop)* ','?)? '}' | '[' ','* (belem (','+ belem)* ','*)? ']'
bprop: ID ('=' assign)? | propname ':' belem | '...' bind
belem: '...'? bind ('=' assign)?
fndecl: 'async'? 'function' '*'? ID tparams? '(' params ')' rettype? block
fnexpr: 'async'? 'function' '*'? ID? tparams? '(' params ')' rettype? block
params: (param (',' param)* ','?)?
param: decorator* tsaccess* '...'? (bind | 'this') tsopt? typeann? ('=' assign)?
decorator: '@' (ID ('.' NAMEANY)* targs? args? | '(' expr ')')
classdecl: decorator* tsabstract? 'class' ID tparams? heritage? classbody
classexpr: decorator* 'class' ID? tparams? heritage? classbody
heritage: 'extends' lhs targs? tsimplements? | tsimplements
classbody: '{' member* '}'
member: ';' | decorator* tsaccess* 'static'? tsaccess* classel | 'static' block | tsindex
classel: methodmod? propname tsopt? tparams? '(' params ')' rettype? (block | tsnobody) | 'accessor'? propname tsopt? tsbang? typeann? ('=' assign)? semi
methodmod: 'async' '*'? | '*' | 'get' | 'set'
propname: NAMEANY | 'STR' | 'NUM' | 'PRIVATE' | '[' assign ']'
expr: assign (',' assign)*
exprnb: assignnb (',' assign)*
assign: lhs tail | unop unary bintail condtail | arrow | 'yield' ('*'? assign)? | tsgenericarrow
assignnb: lhsnb tail | unop unary bintail condtail | arrow | 'yield' ('*'? assign)? | tsgenericarrow
tail: ASSIGN assign | ('++' | '--')? bintail condtail
bintail: (BINARY unary | '>' '>' unary | '>' '>' '>' unary | tsas)*
condtail: ('?' assign ':' assign)?
unary: lhs ('++' | '--')? | unop unary
unop: UNARY
arrow: 'async'? ID '=>' arrowbody | 'async'? '(' params ')' rettype? '=>' arrowbody
arrowbody: block | assignab
assignab: lhsab tail | unop unary bintail condtail | arrow | 'yield' ('*'? assign)? | tsgenericarrow
lhsab: 'new' 'new'* primary suffix* | (primarynb | fnexpr | classexpr) suffix*
lhs: 'new'* primary suffix*
lhsnb: 'new' 'new'* primary suffix* | primarynb suffix*
suffix: '.' (NAMEANY | 'PRIVATE') | '?.' (NAMEANY | 'PRIVATE' | '[' expr ']' | args | tmpl) | '[' expr ']' | args | tmpl | tssuffix
args: '(' ('...'? assign (',' '...'? assign)* ','?)? ')'
tmpl: 'TMPL'
primarynb: ID | 'this' | 'super' | 'null' | 'true' | 'false' | 'NUM' | 'STR' | 'TMPL' | 'REGEX' | 'JSX' | '[' ','* (element (','+ element)* ','*)? ']'
   | '(' expr ')' | 'import' ('.' 'meta' | '(' assign (',' assign)? ','? ')') | 'new' '.' 'target' | 'PRIVATE'
primary: primarynb | objlit | fnexpr | classexpr
element: '...'? assign
objlit: '{' (prop (',' prop)* ','?)? '}'
prop: ID ('=' assign)? | propname ':' assign | methodmod? propname tparams? '(' params ')' rettype? block | '...' assign
importing: 'import' 'STR' attrs? semi | 'import' tstype? clause 'from' 'STR' attrs? semi | tsimport
clause: ID (',' (star | names))? | star | names
star: '*' 'as' ID
names: '{' (name (',' name)* ','?)? '}'
name: tstype? (NAMEANY | 'STR') ('as' (NAMEANY | 'STR'))?
attrs: ('with' | 'assert') objlit
exporting: 'export' ('default' (fnexpr | classexpr | tsdefault | assign semi) | vardecl semi | fndecl | classdecl | tstype? names ('from' 'STR' attrs?)? semi
   | tstype? '*' ('as' (NAMEANY | 'STR'))? 'from' 'STR' attrs? semi | tsexport) | decorator decorator* 'export' 'default'? tsabstract? classexpr
"""

#: In JavaScript the TypeScript rules match nothing, or nothing but the empty word.
JS_ONLY = r"""
never: NEVER
typeann: never
rettype: never
tparams: never
targs: never
tsbang: never
tsopt: never
tsaccess: never
tsabstract: never
tsimplements: never
tsindex: never
tsnobody: never
tsas: never
tsgenericarrow: never
tssuffix: never
tstype: never
tsimport: never
tsdefault: never
tsexport: never
tsstmt: never
"""

TS_RULES = r"""
typeann: ':' type
rettype: ':' (type | 'asserts'? (ID | 'this') 'is' type | 'asserts' (ID | 'this'))
tparams: '<' tparam (',' tparam)* ','? '>'
tparam: ('const' | 'in' | 'out')* ID ('extends' type)? ('=' type)?
targs: '<' type (',' type)* ','? '>'
tsbang: '!'
tsopt: '?'
tsaccess: 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare'
tsabstract: 'abstract' | 'declare' 'abstract'?
tsimplements: 'implements' type (',' type)*
tsindex: 'static'? 'readonly'? '[' ID ':' type ']' typeann semi
tsnobody: semi
tsas: ('as' | 'satisfies') (type | 'const')
tsgenericarrow: 'async'? tparams '(' params ')' rettype? '=>' arrowbody
tssuffix: '!' | targs args | targs 'TMPL'
tstype: 'type'
tsimport: 'import' 'type'? ID '=' ('require' '(' 'STR' ')' | ID ('.' NAMEANY)*) semi
tsdefault: 'abstract' 'class' ID? tparams? heritage? classbody | interface | fnsig
tsexport: '=' expr semi | 'as' 'namespace' ID semi | tsdecl | 'import' ID '=' ID ('.' NAMEANY)* semi
tsstmt: tsdecl
tsdecl: 'declare'? (interface | 'type' ID tparams? '=' type semi | 'const'? 'enum' ID '{' (enumel (',' enumel)* ','?)? '}' | fnsig | space | 'global' '{' item* '}')
   | 'declare' (vardecl semi | ('module' | 'namespace') 'STR' ('{' item* '}' | semi) | classdecl)
space: ('namespace' | 'module') ID ('.' NAMEANY)* '{' item* '}'
interface: 'interface' ID tparams? ('extends' type (',' type)*)? objtype
enumel: propname ('=' assign)?
fnsig: 'async'? 'function' '*'? ID tparams? '(' params ')' rettype? semi
type: fntype | union ('extends' union '?' type ':' type)?
fntype: tparams? '(' params ')' '=>' rettypebody | 'abstract'? 'new' tparams? '(' params ')' '=>' type
rettypebody: type | 'asserts'? (ID | 'this') 'is' type
union: ('|' | '&')? unit (('|' | '&') unit)*
unit: ('keyof' | 'unique' | 'readonly' | 'infer')* tprim ('[' type? ']')*
tprim: ID ('.' NAMEANY)* targs? | 'void' | 'null' | 'this' | 'true' | 'false' | 'STR' | '-'? 'NUM' | 'TMPL' | 'infer' ID ('extends' union)? | objtype | '[' (tuple (',' tuple)* ','?)? ']'
   | '(' type ')' | 'typeof' (ID | 'this') ('.' NAMEANY)* targs? | 'typeof'? 'import' '(' type ')' ('.' NAMEANY)* targs? | fntype
tuple: '...'? type '?'? | '...'? ID '?'? ':' type
objtype: '{' (tmember (tsep tmember)* tsep?)? '}'
tsep: ';' | ',' | 'ASI'
tmember: 'readonly'? propname '?'? typeann? | methodmod? propname '?'? tparams? '(' params ')' rettype? | 'new'? tparams? '(' params ')' rettype?
   | ('readonly' | '+' 'readonly' | '-' 'readonly')? '[' ID (':' type | 'in' type ('as' type)?) ']' (('+' | '-')? '?')? typeann?
"""
TS_OVERRIDES = {
    "assign": "lhs tail | unop unary bintail condtail | arrow | 'yield' ('*'? assign)? | tsgenericarrow | cast bintail condtail",
    "assignab": "lhsab tail | unop unary bintail condtail | arrow | 'yield' ('*'? assign)? | tsgenericarrow | cast bintail condtail",
    "assignnb": "lhsnb tail | unop unary bintail condtail | arrow | 'yield' ('*'? assign)? | tsgenericarrow | cast bintail condtail",
    "unary": "lhs ('++' | '--')? | unop unary | cast",
}

NEVER = frozenset(["\0never"])


@lru_cache(maxsize=None)
def grammar(name: str) -> Grammar:
    """The grammar of ``json``, ``toml``, ``python``, ``js``, ``ts`` or ``tsx``; made once a process."""
    if name == "json":
        return Grammar(JSON_RULES, {})
    if name == "toml":
        return Grammar(TOML_RULES, {"KEY": frozenset(["BARE", "STR"])})
    if name == "python":
        return Grammar(
            PY_RULES,
            {
                "NAME": frozenset(["id"]) | PY_SOFT,
                "AUG": frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()),
                "COMP": frozenset("< > == >= <= != in".split()),
                "BINOP": frozenset("| ^ & << >> + - * / // % @".split()),
                "SIGN": frozenset("+ - ~".split()),
            },
        )
    ids = frozenset(["id"]) | JS_CONTEXTUAL
    classes = {
        "ID": ids,
        "NAMEANY": ids | JS_RESERVED,
        "NEVER": NEVER,
        "ASSIGN": frozenset("= += -= *= /= %= **= <<= >>= >>>= &= ^= |= &&= ||= ??=".split()),
        "BINARY": frozenset("?? || && | ^ & == != === !== < > <= >= instanceof in << + - * / % **".split()),
        "UNARY": frozenset("delete void typeof + - ~ ! await ++ -- NL++ NL--".split()),
    }
    if name == "js":
        return Grammar(JS_RULES.strip() + "\n" + JS_ONLY.strip(), classes)
    rules = JS_RULES.strip()
    if name == "ts":  # the old casts would be elements in .tsx
        import re

        for rule, body in TS_OVERRIDES.items():
            rules = re.sub(rf"(?m)^{rule}: .*$", lambda _: f"{rule}: {body}", rules)  # noqa: B023
        rules += "\ncast: '<' type '>' unary"
    return Grammar(rules + "\n" + TS_RULES.strip(), classes)
