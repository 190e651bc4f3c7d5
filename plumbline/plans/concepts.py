"""What the detectors mean by request data, guards, records, limits and the like.

Each pattern is put together from the words of one concept; see :mod:`vocabulary` for the
shapes. Where a rule needs several of these, it names them in its clause.
"""

from __future__ import annotations

from plumbline.plans import vocabulary as V

# What the caller of a handler sends.
FROM_CALLER = V.either(
    rf"\b(?:{V.listed(V.REQUEST)})\s*\.",
    V.part("params form-data next-url payload user-input"),
    V.word("body input"),
    r"\bquery\s*\.",
)
ADDRESS_NAME = r"\b(?:callback|feed|image|remote|source|target|webhook)(?:Ur[il]|URL)\b"
ADDRESS_FROM_CALLER = V.either(FROM_CALLER, ADDRESS_NAME)

# Where a response sends the browser, and what keeps it on the own site.
SENDS_AWAY = V.either(
    V.named_call("redirect"),
    V.named_call("permanent temporary", "redirect"),
    r"\blocation\s*(?:\.\s*(?:assign|href|replace)\s*)?[=(]",
)
STAYS_HERE = V.either(
    V.method("startsWith startswith") + rf"\s*{V.QUOTE}/",
    V.part("allow-list white-list"),
    r"(?i:\b\w*(?:allow(?:ed)?|known|safe|trusted)[-_]?(?:host|origin|path|redirect|return|target|url)\w*)",
    r"\.\s*(?:host(?:name)?|origin)\s*[!=]={1,2}",
    r"\bnew\s+URL\s*\([^)\n]*\)[^\n]*\.\s*(?:host(?:name)?|origin)\b",
)

# What an account is given for money or rank, and what shows that it may be.
GRANTED = (
    rf"(?:(?:{V.listed('membership package plan tier')})(?:_?[iI]d)?|subscription(?:_?[pP]lan|_?[tT]ier)?"
    rf"|{V.listed('permission permissions role roles scopes')}|is_?(?:[aA]dmin|[oO]wner|[pP]remium|[pP]ro|[sS]taff)"
    rf"|{V.listed('credits entitlements features limits packs quota seats')}|enabled_?(?:[fF]eatures|[mM]odules))"
)
MAY_GRANT = V.either(
    rf"\b(?:{V.listed(V.GUARD_VERBS)})[A-Z_]\w*\s*\(",
    V.named_call(V.CHECK_VERBS, V.RIGHTS),
    r"\b[A-Z][A-Z0-9_]+\s*\.\s*(?:has|includes|indexOf)\s*\(",
)
PAID_FOR = V.part("checkout invoice lemonsqueezy paddle payment-intent price-id stripe webhook")
PROVEN = V.either(V.part("create-hmac timing-safe-equal"), V.named_call("validate verify", V.SIGNED), V.member("jwt", "verify"))
GRANT_IS_GUARDED = V.either(MAY_GRANT, PAID_FOR, PROVEN)

# Routes that have to be open.
_SIGN_IN = r"(?:log|sign)[-_]?(?:in|off|on|out|up)|regist(?:er|ration)|oauth\d?|oidc|saml|sso|auth|callback"
_RECOVER = r"(?:change|forgot(?:ten)?|recover|reset)[-_]?password|(?:activate|confirm|verify)[-_]?e?mail|magic[-_]?link"
_ALIVE = r"(?:health|live|ready)(?:check|ness|z)?|heartbeat|ping|status"
_READ_BY_MACHINES = r"manifest|robots|sitemap|favicon|(?:apple-)?icon|og|(?:opengraph|twitter)-image"
_ONE_CLICK = r"beacon|open|pixel|public|track(?:ing)?|unsubscribe"
OPEN_ROUTE = rf"(?i:/(?:{_SIGN_IN}|{_RECOVER}|{_ALIVE}|{_READ_BY_MACHINES}|{_ONE_CLICK})\b|\[\.\.\.\w*(?:auth|clerk|kinde)\])"
OPEN_HANDLER = V.either(r"\b(?:ImageResponse|NextAuth|createRouteHandler|toNextJsHandler)\b", r"\bhandlers\s*\}")

# Bounds on calls and on cost.
LIMITED = V.either(V.part("bottleneck leaky-bucket rate-limit sliding-window slow-down throttl token-bucket"), V.word("limiter"))
CALLS_LIMITED = V.either(LIMITED, V.part("limiter. write-limit"))
COST_LIMITED = V.either(V.part("budget quota max-tokens"), r"(?i:(?:cost|credit|daily|monthly|spend)\w*[-_]?(?:cap|limit|max)\w*)")
COUNTED = V.either(V.part("brute deneme kilit lock-out too-many"), r"(?i:attempts?\b)", r"\b429\b", r"(?i:istek[ _]?sinir)")
IN_MEMORY = r"^(?:const|let|var)\s+\w+\s*(?::[^=\n]+)?=\s*(?:new\s+(?:Map|Set|WeakMap)\b|\{\s*\}|\[\s*\])"
BOUNDED = V.either(
    r"(?i:\bcap\b|_cap\b|\bmax[_A-Z]|\bmax(?:imum)?\b|_max\b)",
    V.part("azami batch-size budget esik kota limit quota threshold"),
    r"\[\s*:\s*\d",
    V.call("head slice take"),
    r"\bbreak\b",
)
DECIDES_ACCESS = V.either(LIMITED, COUNTED, V.part("allow-list block-list white-list"), r"(?i:\bban(?:ned)?\b)")
WORTH_LIMITING = rf"(?i:{_SIGN_IN.replace('|auth|callback', '')}|otp|verify|(?:forgot|reset)-?password|charge|checkout|pay(?:ment)?|tahsilat)"

# Values made safe.
MADE_SAFE = V.either(
    rf"\b\w*(?i:{V.listed('escap normali purif saniti')})\w*\s*\(",
    rf"\b(?i:{V.listed('basename isAllow isSafe isValid safe validat')})\w*\s*\(",
)
HTML_FROM_OUTSIDE = V.either(
    FROM_CALLER,
    V.word("cms comment description message props"),
    V.call("fetch getData"),
    V.method("get"),
    V.member("document window", "location"),
    V.member("location", "hash href search"),
)
RAW_HTML = rf"(?i:__html)\s*:[^\n]*{HTML_FROM_OUTSIDE}"
HTML_IS_SAFE = V.either(
    V.named_call("clean escape purify sanitize strip xss"),
    V.part("dompurify escape-json-ld escape-html"),
    r"application/ld\+json",
    r"__html\s*:\s*(?:JSON\s*\.\s*stringify\s*\(|\"[^\"\n]*\"|'[^'\n]*')",
)

# Columns of people and of secrets.
_SUFFIX = r"(?:[_-]?(?:code|no|num|number))?"


def column(words: str) -> str:
    return rf"(?i:\b(?:{V.listed(words).replace('-', '[_-]?')}){_SUFFIX}\b)"


IDENTITY_COLUMNS = "kimlik national-id passport social-security ssn tax-id tc-kimlik tckn"
MONEY_COLUMNS = "card-number cardnum cc-number credit-card cvc cvv debit-card iban"
BODY_COLUMNS = "biometric diagnose diagnosis health medical"
KEY_COLUMNS = "api-key private-key secret-key"
SENSITIVE_COLUMN = V.either(column(IDENTITY_COLUMNS), column(MONEY_COLUMNS), r"(?i:\bcard[_-]?n(?:o|um|umber)\b)", column(BODY_COLUMNS), column(KEY_COLUMNS))
TEXT_COLUMN = V.word("char citext clob longtext mediumtext nvarchar string text varchar")
ANY_COLUMN = V.word("bool boolean char date enum int integer json jsonb smallint string text varchar")
NOT_PLAIN = V.either(V.part("argon bcrypt bytea cipher crypto decrypt encrypt hashed kms pgp-pub pgp-sym scrypt sodium"), V.word("vault"), r"\.\s*hash\b")
TOKEN_WRITTEN = r"(?i:\b(?:(?:access|bearer|oauth|refresh)[-_]?token|(?:api|secret)[-_]?key|client[-_]?secret))\s*:\s*[^,\n}]+"
ACCOUNT_LINK = V.either(V.part("@auth/ adapter-account drizzle-adapter link-account next-auth prisma-adapter"), r"\baccount\s*\.\s*provider\w*")
_HEALTH = "blood-type diagnose diagnosis disability disease hasta health kan-grubu medical patient saglik"
_BODY = "biometric dna face-id fingerprint genetic"
_BELIEF = "ethnic ethnicity etnik mezhep religion religious"
SPECIAL_COLUMN = rf"(?i:\b(?:{V.listed(' '.join([_HEALTH, _BODY, _BELIEF])).replace('-', '[_-]?')})(?:[_-]\w+)?\b)"

# SQL built from names.
STATEMENT = V.either(V.word("delete insert select update"), r"(?i:\b(?:group|order)\s+by\b)")
_NAME_FOLLOWS = r"(?i:\b(?:from|(?:group|order)\s+by|into|join|set|table|update)\b)"
NAME_IN_TEMPLATE = _NAME_FOLLOWS + r"\s*\$\{[A-Za-z_]\w*\}"
NAME_IN_FORMAT = _NAME_FOLLOWS + r"[^\"'\n]*\{[A-Za-z_]|\{[^{}\n]*\}\s*=\s*[%?]"
_SQL_PART = rf"(?:\w*(?i:{V.listed('clause cond filter kosul sql where')})\w*|[A-Z][A-Z0-9_]*)"
SQL_PART_IN_FORMAT = rf"\{{{_SQL_PART}\}}"
SQL_PART_IN_TEMPLATE = rf"\$\{{(?:{_SQL_PART}|\w*(?i:columns|sutun)\w*)\}}"
KEYS_FROM_CALLER = V.either(V.method("items keys") + r"\s*\)", r"\brequest\s*\.", V.member("args form", "get"), r"\b(?:params|query)\s*\[")
NAMES_LISTED = V.either(V.part("allow-list frozenset white-list"), r"_COLUMNS\b|_FIELDS\b", V.method("includes"))

# Origins, leftovers, moments.
ORIGIN_CHECKED = V.either(
    V.part("allow-list allowed-origin cors-origins trusted-origin white-list"),
    r"(?i:\borigins?)\s*\.\s*(?:has|includes)\s*\(",
    r"\.\s*includes\s*\(\s*(?i:origin)",
    r"(?i:\borigin)\s*={3}",
)
LEFTOVER = (
    r"(?i:\.(?:bak|old|orig|save|swp)$|\.yedek(?:[-.][\w.-]*)?$|~$|\bcopy(?:\s*\d+)?\.|\bkopya\b|[-.]oncesi[-.]"
    r"|\.eski(?:[.-][\w.-]*)?(?:/|$)|(?:^|/)(?:backup|yedek(?:ler)?)(?:/|$))"
)
A_MOMENT = V.either(
    rf"(?i:\b\w*(?:{V.listed('created deleted duration elapsed ended expir modified seen since started timestamp until updated')})\w*\s*[:=])",
    r"\b\w+(?:At|Date|Since|Stamp|Time)\s*[:=]",
)

# Requests to elsewhere.
CALLS_OUT = (
    V.either(V.call("axios fetch got request"), V.member("axios http https", "get head patch post put request") + r"\s*\(")
    + r"\s*(?:`[^`\n]*\$\{|[`$\{]*[A-Za-z_]\w*)"
)
HOST_LISTED = V.either(
    V.part("allow-list allowed-domains allowed-hosts white-list"),
    V.named_call("is", "allow public safe trusted valid"),
    r"\bnew\s+URL\b[\s\S]{0,80}\bhost(?:name)?\b[\s\S]{0,60}(?:={2,3}|\.\s*(?:endsWith|has|includes|match|startsWith|test)\s*\()",
)

# Cross-site requests, webhooks, audit trails.
CALLER_IS_SIGNED = V.either(V.part("construct-event svix webhook"), V.named_call("verify", "signature"), r"(?i:\w+-signature\b)")
CALLER_HAS_TOKEN = V.either(r"(?i:\bauthorization\b)", V.word("bearer"), V.part("api-key-header x-api-key"))
CROSS_SITE_CHECKED = V.either(V.part("__host- csrf double-submit xsrf"), V.named_call("assert check verify", "origin"), r"(?i:origin\s+check)")
GIVES_ACCESS = V.either(
    V.named_call("activate grant"),
    V.named_call("change extend mark set upgrade", "access credit paid plan subscription trial"),
    r"(?i:\bpaid(?:_?until)?\s*[:=])",
    V.part("entitle"),
)
EVENT_STORED = V.either(
    V.part("on-conflict payment-events processed-events webhook-events"),
    r"(?i:\binsert\s+into\s+\w*(?:event|webhook)\w*)",
    V.named_call("claim", "event"),
    V.word("unique"),
)
LOCK_EXPIRES = V.either(
    V.named_call("rate", "limit"),
    V.part("expire max-age set-ex window-ms"),
    r"(?i:\bttl\s*[:=]|\bcache\s*\.\s*set\s*\(|\blru\b)",
    r"\b(?:EX|PX)\b|\bMap\s*\(\s*\)",
)
EVENT_NAME = V.part("event-id evt: idempoten merchant-oid webhook:")
LEAVES_A_TRACE = V.either(
    V.member("console log logger", "audit debug error info log warn"),
    V.named_call("audit capture log record track", "action event log message"),
    V.call("track"),
    V.part("audit-log logtail pino sentry winston"),
)

# Links that are chosen for a reader.
SHORT_WORDS_LEFT_OUT = (
    r"\.\s*(?:every|filter|some)\s*\([^\n=]*=>[^\n]*\w\s*\.\s*length\s*>=?\s*\d+"
    r"|(?i:\b(?:\w*(?:blacklist|dolgu|exclude|generic|jenerik|stop)\w*)\s*[.(])"
)
WORD_FORMS = V.part("content-word finite-verb function-words lemma morpholog stemm zemberek")
RELATED = V.part("alaka benzer cosine embedding ortusme overlap puan relevan score similar tf-?idf")

# Databases with a server, and foreign keys switched on.
SERVER_DATABASE = V.either(
    r"(?:\bfrom|\brequire\s*\()\s*['\"]pg['\"]",
    r"(?i:\b(?:mysql|postgres(?:ql)?)://)",
    V.part("@neondatabase asyncpg drizzle-orm/mysql drizzle-orm/pg mongoose psycopg"),
    r"\bneon\s*\(",
)
KEYS_ENFORCED = r"(?i:\bforeign_keys['\"]?\s*[=,(]?\s*(?:1|ON|TRUE)\b|\bpragma\s*\(\s*['\"]foreign_keys)"
INPUT_VALIDATED = V.either(V.word("joi valibot yup zod"), V.part("class-validator express-validator zod-resolver"), V.method("safeParse"), r"\bz\s*\.\s*object\s*\(")

# Files: what stores them, what makes them, what comes with them.
STORES_A_FILE = V.either(V.named_call("write", "file stream"), V.call("createWriteStream multer putObject upload"), V.method("save"))
WRITES_A_PATH = V.either(
    V.named_call("write"),
    V.member("fs", "write"),
    r"\b(?i:open)\s*\([^)]*['\"][aw]",
    r">\s*['\"]?[\w./-]+",
)
BY_HAND = V.part("addition append ekler elle extra manual")
MADE_BY_MACHINE = V.part("@generated auto-generated do-not-edit generated-by")
#: Endings of files that a bundler takes as they are.
STYLE_ENDINGS, PICTURE_ENDINGS = "css less sass scss styl", "avif gif ico jpeg jpg png svg webp"
FONT_ENDINGS, MEDIA_ENDINGS = "eot ttf woff woff2", "glb gltf mp3 mp4 wasm webm"
TEXT_ENDINGS = "csv gql graphql md txt xml yaml yml"
BUNDLED = r"(?i:\.(?:" + "|".join(V.listed(e) for e in (STYLE_ENDINGS, PICTURE_ENDINGS, FONT_ENDINGS, MEDIA_ENDINGS, TEXT_ENDINGS)) + r")$)"
#: Third parties whose scripts any page may embed.
VIDEO, ADVERTS, SOCIAL = "vimeo youtube youtube-nocookie ytimg", "doubleclick googletagmanager google-analytics hotjar clarity", "facebook fbcdn linkedin tiktok twitter x"
EMBEDDED = rf"(?:^|\.)(?:{V.listed(' '.join([VIDEO, ADVERTS, SOCIAL]))})\.[a-z.]+$|^(?:google|gstatic)\.com$"

# Log calls, by ending of the file: receivers and their methods.
_LEVELS = "debug error info warn"
LOGGED_IN = [
    (r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", V.either(V.member("console", _LEVELS + " log"), V.member("log logger", _LEVELS + " log trace"), r"\bprocess\s*\.\s*std(?:err|out)\s*\.\s*write\b", r"\bcapture(?:Exception|Message)\b") + r"\s*\("),
    (r"\.py$", V.member("log logger logging", _LEVELS + " critical exception warning") + r"\s*\("),
    (r"\.go$", V.either(r"\bfmt\s*\.\s*Print(?:f|ln)?\b", r"\blog\s*\.\s*(?:Fatal|Print)(?:f|ln)?\b") + r"\s*\("),
    (r"\.rs$", r"\b(?:e?println|debug|error|info|warn)!\s*\("),
    (r"\.rb$", V.either(r"\bpp\b", r"\bputs\b", V.member("logger", _LEVELS + " fatal")) + r"\s+"),
    (r"\.php$", V.call("error_log print_r var_dump")),
    (r"\.(?:java|kt)$", V.either(r"\bSystem\s*\.\s*(?:err|out)\s*\.\s*print(?:ln)?\b", V.member("log logger", _LEVELS)) + r"\s*\("),
]

# Monitors and gates.
_ALERTS = V.part("alarm alert notif pager slack telegram")
ALERT_SENT = V.either(rf"\b(?:import|require)\b[^;\n]{{0,80}}{V.QUOTE}[^'\"`\n]*{_ALERTS}", V.named_call("alerts dispatch notify send", "alert configured"), V.call("notify"))
FIRST_SETUP = V.part("bootstrap fallback gate initial kurulum legacy ortak setup shared")
