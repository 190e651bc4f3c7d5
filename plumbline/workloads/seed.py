"""A source corpus derived from the documents table.

Each document becomes one file: a small code skeleton chosen by its id, followed by
the whole document text (as a block comment in script and SQL files). So every
detector has something to find, and work grows with the documents. The skeletons are
also the fixtures of the unit tests: ``fires`` names the rules a skeleton group
triggers when it is a project of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.workloads.common import spread, table

# Fewer than lie between two skeletons with the same fixed path, so paths stay unique.
FILES_PER_PROJECT = 20


@dataclass(frozen=True)
class Seed:
    group: str
    path: str
    body: str
    fires: tuple[str, ...] = ()
    tracked: bool = True


def bad(rule, *files, tracked=True):
    group = "bad:" + rule
    return [Seed(group, p, b, (rule,), tracked) for p, b in files]


def ok(rule, *files, tracked=True):
    """A look-alike that must not fire ``rule``."""
    group = "ok:" + rule
    return [Seed(group, p, b, (), tracked) for p, b in files]


SK = "sk_" + "live_"
HEX40 = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"

def steps(n: int, line: str) -> str:
    """Many lines of plain code, longer than any fixed window."""
    return "".join(line.format(i=i) + "\n" for i in range(n))


SEEDS: list[Seed] = [
    *bad("a01-client-controlled-entitlement", ("src/lib/{id}tenant.ts", "export async function save(req) {\n  const body = await req.json();\n  await orm.tenant.update({\n    plan: body.plan,\n  });\n}")),
    *bad("a01-client-controlled-entitlement", ("src/lib/{id}member.ts", "export async function join(req) {\n  const wanted = req.body.role;\n  await orm.member.create({\n    role: wanted,\n  });\n}")),
    *ok("a01-client-controlled-entitlement", ("src/lib/{id}grant.ts", "export async function grant(req) {\n  requireRole('owner');\n  await orm.tenant.update({\n    plan: req.body.plan,\n  });\n}")),
    *bad("int-page-api-auth-divergence",
         ("src/app/{id}x/tenant/page.tsx", "import x from 'y';\nexport default async function Page() {\n  const u = await getUserSession();\n  return null;\n}"),
         ("src/app/api/{id}t/route.ts", "export async function GET() {\n  const a = await getTenantActor();\n  return a;\n}"),
         ("src/lib/{id}ids.ts", "export async function getUserSession() {\n  return cookies().get('s');\n}\nexport async function getTenantActor() {\n  return cookies().get('t');\n}")),
    *ok("int-page-api-auth-divergence", ("src/app/{id}y/tenant/page.tsx", "export default async function Page() {\n  const u = await getTenantActor();\n  return null;\n}")),
    *bad("a01-server-action-auth-missing", ("src/app/{id}items/actions.ts", '"use server";\nexport async function removeItem(id) {\n  await prisma.item.delete({ where: { id } });\n}')),
    *ok("a01-server-action-auth-missing", ("src/app/login/{id}actions.ts", '"use server";\nexport async function start(id) {\n  await prisma.item.delete({ where: { id } });\n}')),
    *bad("int-scope-hand-enumerated", ("src/lib/{id}scope.ts", "export function scopeFor(a, all) {\n  return {\n    ...all,\n" + "".join(f"    k{i}: keep(all.k{i}),\n" for i in range(9)) + "  };\n}")),
    *ok("int-scope-hand-enumerated", ("src/lib/{id}scopes.ts", "export function scopeFor(a, all) {\n  return {\n    ...all,\n    k1: keep(all.k1),\n    k2: keep(all.k2),\n  };\n}")),
    *bad("int-permission-after-validation", ("src/app/api/{id}pv/route.ts", "export async function POST(r) {\n  const v = schema.parse(await r.json());\n  if (!canManage(v)) return deny();\n  return v;\n}")),
    *ok("int-permission-after-validation", ("src/app/api/{id}pw/route.ts", "export async function POST(r) {\n  if (!canManage(r)) return deny();\n  const v = schema.parse(await r.json());\n  return v;\n}")),
    *bad("a01-api-route-auth-missing", ("src/app/api/{id}orders/route.ts", "export async function POST(r) {\n  return prisma.order.create({ data: fixed });\n}")),
    *bad("a01-api-route-auth-missing", ("src/app/api/{id}list/route.ts", "export async function GET() {\n  return prisma.order.findMany();\n}")),
    *ok("a01-api-route-auth-missing", ("src/app/api/{id}mine/route.ts", "export async function POST(r) {\n  await requireAdmin();\n  return prisma.order.create({ data: fixed });\n}")),
    *bad("a01-idor-direct-object-reference", ("src/app/api/{id}doc/route.ts", "export async function GET(r, { params }) {\n  const id = params.id;\n  return store.doc.findUnique({ where: { id } });\n}")),
    *ok("a01-idor-direct-object-reference", ("src/app/api/{id}own/route.ts", "export async function GET(r, { params }) {\n  const id = params.id;\n  return store.doc.findUnique({ where: { id, userId: me } });\n}")),
    *bad("a01-supabase-service-role-key", ("src/components/{id}panel.tsx", "const k = settings.serviceRoleKey;")),
    *bad("a01-supabase-service-role-key", ("src/lib/{id}admin.ts", "const k = settings.serviceRoleKey;")),
    *ok("a01-supabase-service-role-key", ("docs/{id}notes.md", "The serviceRoleKey stays on the server.")),
    *bad("a01-missing-rls",
         ("package.json", '{"name":"a","scripts":{"dev":"x"},"dependencies":{"@supabase/supabase-js":"^2.0.0","next":"^14.0.0"}}'),
         ("src/lib/{id}browser.ts", "export const c = createBrowserClient(url, anonKey);"),
         ("db/{id}tables.sql", "create table notes{id} (\n  id int\n);\ncreate table safe{id} (id int);\nalter table safe{id} enable row level security;\ncreate table auth.users{id} (id int);")),
    *bad("a01-open-redirect", ("src/app/{id}go/handler.ts", "export function go(req, res) {\n  res.redirect(req.query.next);\n}")),
    *bad("a01-open-redirect", ("src/app/{id}go2/handler.ts", "export function go(req) {\n  const target = req.query.next;\n  return redirect(target);\n}")),
    *ok("a01-open-redirect", ("src/app/{id}go3/handler.ts", "export function go(req) {\n  const target = req.query.next;\n  if (!target.startsWith('/')) return home();\n  return redirect(target);\n}")),
    *bad("a01-csrf-missing", ("src/app/api/{id}profile/route.ts", "export async function POST(r) {\n  const s = await getServerSession();\n  const f = await r.formData();\n  return save(s, f);\n}")),
    *ok("a01-csrf-missing", ("src/app/api/{id}profile2/route.ts", "export async function POST(r) {\n  const s = await getServerSession();\n  verifyCsrf(r);\n  return save(s);\n}")),
    *bad("a01-mass-assignment", ("src/server/{id}users.ts", "export async function edit(req) {\n  await orm.user.update({ data: req.body });\n}")),
    *bad("a01-mass-assignment", ("src/server/{id}users2.ts", "export async function edit(req) {\n  const values = await req.json();\n  await orm.user.update({ data: values });\n}")),
    *ok("a01-mass-assignment", ("src/server/{id}users3.ts", "export async function edit(req) {\n  const values = schema.parse(await req.json());\n  await orm.user.update({ data: values });\n}")),
    *bad("a01-path-traversal", ("src/app/api/{id}file/route.ts", "import { readFileSync } from 'fs';\nexport async function GET(req) {\n  return readFileSync(req.query.name);\n}")),
    *bad("a01-path-traversal",
         ("src/lib/{id}reader.ts", "import { readFileSync } from 'fs';\nexport function load(params) {\n  return readFileSync(params.name);\n}"),
         ("src/app/api/{id}load/route.ts", "import { load } from '../../lib/{prev}reader';\nexport async function GET(req) {\n  return load(req);\n}")),
    *ok("a01-path-traversal", ("src/app/api/{id}file2/route.ts", "import { readFileSync } from 'fs';\nexport async function GET(req) {\n  return readFileSync('fixed.txt');\n}")),
    *bad("a02-pii-in-repo", ("data/{id}people.csv", "first_name,street,phone,score\nAda,Oak 1,555,1\n")),
    *bad("a02-pii-in-repo", ("data/{id}people.jsonl", '{"ownerName":"Ada","homeAddress":"Oak 1","n":1}\n{"ownerName":"Bo","homeAddress":"Elm 2","n":2}\n')),
    *ok("a02-pii-in-repo", ("data/{id}items.csv", "sku,street,count\n1,x,2\n")),
    *ok("a02-pii-in-repo", ("data/{id}empty.csv", "first_name,street,phone")),
    *bad("a02-pii-in-generated-output", ("out_pages/{id}report.html", "<ul>" + "".join(f"<li>{n} Maple Street</li>" for n in range(11, 20)) + "</ul>")),
    *bad("a02-pii-in-generated-output",
         ("pages_out/{id}short.md", "Visit 11 Maple Street, 12 Cedar Road and 13 Birch Lane."),
         ("tools/{id}render.mjs", "writeFileSync('pages_out/{prev}short.md', body);")),
    *ok("a02-pii-in-generated-output", ("docs/{id}visit.md", "Visit 11 Maple Street, 12 Cedar Road and 13 Birch Lane.")),
    *bad("a02-hardcoded-secret", ("src/lib/{id}pay.ts", f'const key = "{SK}abcdEFGH1234ijkl";')),
    *bad("a02-hardcoded-secret", ("src/lib/{id}sync.py", 'api_token = "aG7kQ2xLm9ZtR4vB8nWcY1pD"')),
    *ok("a02-hardcoded-secret", ("src/lib/{id}pay2.ts", 'const key = process.env.PAY_KEY;\nconst SECRET = "PAY_WEBHOOK_SECRET";\nconst apiKey = "your-api-key-here-please";')),
    *bad("a02-env-file-committed", (".env.{id}", "PAY_KEY=abcdefgh12345\n"), (".gitignore", "node_modules\n.env*\n")),
    *ok("a02-env-file-committed", (".env.{id}.example", "PAY_KEY=abcdefgh12345\nALERT_WEBHOOK=https://x.example\n")),
    Seed("local-env", ".env.{id}", "PAY_KEY=abcdefgh12345\n", ("a02-env-file-committed",), False),
    *bad("a02-next-public-secret-leak", ("src/lib/{id}env.ts", "const k = process.env.NEXT_PUBLIC_SUPABASE_SERVICE_ROLE_KEY;")),
    *ok("a02-next-public-secret-leak", ("src/lib/{id}env2.ts", "const k = process.env.NEXT_PUBLIC_SUPABASE_ANON_KEY;")),
    *bad("a02-weak-hash-or-jwt-secret", ("src/lib/{id}pw.ts", "export function store(password) {\n  return createHash('md5').update(password).digest('hex');\n}")),
    *bad("a02-weak-hash-or-jwt-secret", ("src/lib/{id}sig.ts", 'const SIGNING_KEY = "winter-is-long-2020";\nexport const t = jwt.sign(claims, SIGNING_KEY);')),
    *ok("a02-weak-hash-or-jwt-secret", ("src/lib/{id}etag.ts", "export function tag(page) {\n  return createHash('md5').update(page).digest('hex');\n}")),
    *bad("a02-sensitive-data-plaintext", ("db/{id}people.sql", "create table people{id} (\n  ssn text not null\n);\nalter table people{id} enable row level security;")),
    *bad("a02-sensitive-data-plaintext", ("src/lib/{id}conn.ts", "export async function keep(row) {\n  await orm.conn.create({ data: {\n    accessToken: row.value,\n  } });\n}")),
    *ok("a02-sensitive-data-plaintext", ("src/lib/{id}conn2.ts", "export async function keep(row) {\n  await orm.conn.create({ data: {\n    accessToken: encrypt(row.value),\n  } });\n}")),
    *bad("kvkk-special-category-data", ("db/{id}clinic.sql", "create table clinic{id} (\n  blood_type varchar(3),\n  religion text\n);\nalter table clinic{id} enable row level security;")),
    *bad("a03-sql-injection", ("src/server/{id}find.ts", "export function find(db, req) {\n  return db.query(`SELECT * FROM users WHERE id = ${req.params.id}`);\n}")),
    *bad("a03-sql-injection", ("src/server/{id}find2.ts", 'export function find(db, name) {\n  return db.execute("SELECT id FROM users WHERE name = \'" + name);\n}')),
    *ok("a03-sql-injection", ("src/server/{id}find3.ts", "export function find(db, id) {\n  return db.query('SELECT id FROM users WHERE id = $1', [id]);\n}")),
    *bad("a03-sql-identifier-injection", ("src/server/{id}rows.py", 'def rows(con, request):\n    col = request.args.get("col")\n    return con.run(f"SELECT id FROM items ORDER BY {col}")')),
    *bad("a03-sql-identifier-injection", ("src/server/{id}rows.ts", "export function rows(con, req) {\n  const table = req.query.table;\n  return con.all(sql(`SELECT id FROM ${table}`));\n}")),
    *ok("a03-sql-identifier-injection", ("src/server/{id}rows2.py", 'def rows(con):\n    return con.run("SELECT id FROM items ORDER BY id")')),
    *bad("a03-redos", ("src/lib/{id}search.ts", "export function hits(req, rows) {\n  const rx = new RegExp(req.query.q);\n  return rows.filter((r) => rx.test(r));\n}")),
    *ok("a03-redos", ("src/lib/{id}search2.ts", 'export function fixed(rows) {\n  const rx = new RegExp("^a+$");\n  return rows;\n}')),
    *bad("a03-prototype-pollution", ("src/lib/{id}merge.ts", "export function set(target, v) {\n  target.__proto__ = v;\n}")),
    *bad("a03-prototype-pollution", ("src/lib/{id}merge2.ts", "export function load(req) {\n  return deepMerge(defaultsOf, req.body);\n}")),
    *bad("a03-dangerous-execution-sink", ("src/ui/{id}view.tsx", "export function V(props) {\n  return <div dangerouslySetInnerHTML={{ __html: props.html }} />;\n}")),
    *bad("a03-dangerous-execution-sink", ("src/lib/{id}run.ts", "import { execSync } from 'child_process';\nexport function run(req) {\n  return execSync(req.body.cmd);\n}")),
    *bad("a03-dangerous-execution-sink", ("src/lib/{id}calc.ts", "export function calc(text) {\n  return eval(text);\n}")),
    *ok("a03-dangerous-execution-sink", ("src/ui/{id}view2.tsx", "export function V(props) {\n  return <div dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(props.html) }} />;\n}")),
    *bad("webhook-idempotency-ttl", ("src/app/api/{id}webhook/route.ts", "export async function POST(r) {\n  const key = `evt:${id}`;\n  await kv.setex(key, 3600, 1);\n  await markPaid(id);\n  return createHmac(r);\n}")),
    *ok("webhook-idempotency-ttl", ("src/app/api/{id}webhook2/route.ts", "export async function POST(r) {\n  const key = `evt:${id}`;\n  await kv.setex(key, 3600, 1);\n  await db.processedEvents.add(key);\n  await markPaid(id);\n  return createHmac(r);\n}")),
    *bad("int-sql-dialect-leftover",
         ("package.json", '{"name":"b","scripts":{"build":"x"},"dependencies":{"pg":"^8.0.0"}}'),
         ("db/{id}report.sql", "select ifnull(a, 0) from t where strftime('%Y', d) = '2024';")),
    *ok("int-sql-dialect-leftover", ("db/{id}report2.sql", "select coalesce(a, 0) from t;")),
    *bad("int-ic-link-alakasiz-capa", ("src/lib/{id}links.ts", "export function link(posts, i) {\n  const p = posts[i % posts.length];\n  return `<a href=\"/p/${p.slug}\">${p.name}</a>`;\n}")),
    *ok("int-ic-link-alakasiz-capa", ("src/lib/{id}links2.ts", "export function link(posts, i) {\n  const best = relevance(posts);\n  const p = posts[i % posts.length];\n  return `<a href=\"/p/${p.slug}\">${p.name}</a>`;\n}")),
    *bad("a04-missing-rate-limit", ("src/app/api/{id}login/route.ts", "export async function POST(r) {\n  console.log('login');\n  return check(r);\n}")),
    *ok("a04-missing-rate-limit", ("src/app/api/{id}signin/route.ts", "import { Ratelimit } from '@upstash/ratelimit';\nexport async function POST(r) {\n  await limiter.check(r);\n  return check(r);\n}")),
    *bad("a04-sqlite-no-busy-timeout", ("app/{id}store.py", "import sqlite3\ncon = sqlite3.connect('x.db')\ncon.execute('INSERT INTO t VALUES (1)')\ncon.commit()")),
    *bad("a04-check-then-act-upsert", ("app/{id}upsert.py", "def save(con, k):\n    row = con.execute('SELECT v FROM stock WHERE k = ?', (k,))\n    if row:\n        con.execute('UPDATE stock SET v = 1 WHERE k = ?', (k,))\n    else:\n        con.execute('INSERT INTO stock VALUES (?, 1)', (k,))\n")),
    *bad("a04-check-then-act-upsert", ("src/lib/{id}first.ts", "export async function put(k) {\n  const row = await orm.stock.findUnique({ where: { k } });\n  if (!row) {\n    await orm.stock.create({ data: { k } });\n  }\n}")),
    *ok("a04-check-then-act-upsert", ("app/{id}upsert2.py", "def save(con, k):\n    row = con.execute('SELECT v FROM stock WHERE k = ?', (k,))\n    con.execute('UPDATE stock SET v = 1 WHERE k = ?', (k,))\n    con.execute('INSERT INTO stock VALUES (?, 1) ON CONFLICT DO NOTHING', (k,))\n")),
    *bad("a04-inmemory-ratelimit-serverless",
         ("vercel.json", '{"crons": []}'),
         ("src/lib/{id}guardrate.ts", "const hits = new Map();\nexport function tooMany(ip) {\n  const attempts = hits.get(ip);\n  return attempts > 5;\n}")),
    *ok("a04-inmemory-ratelimit-serverless", ("src/lib/{id}guardrate2.ts", "import { kv } from '@vercel/kv';\nconst hits = new Map();\nexport function attempts(ip) {\n  return kv.incr(ip);\n}")),
    *bad("a04-tarih-utc-gun-kaymasi", ("src/lib/{id}day.ts", "export function next(d) {\n  d.setDate(d.getDate() + 1);\n  return d.toISOString().slice(0, 10);\n}")),
    *ok("a04-tarih-utc-gun-kaymasi", ("src/lib/{id}day2.ts", "export function next(y, m, d) {\n  const t = new Date(Date.UTC(y, m, d));\n  return t.toISOString().slice(0, 10);\n}")),
    *bad("a04-fk-cascade-off",
         ("app/{id}link.py", "import sqlite3\ncon = sqlite3.connect('y.db', timeout=5)"),
         ("db/{id}child.sql", "create table child{id} (\n  pid int references parent{id}(id) on delete cascade\n);\nalter table child{id} enable row level security;")),
    *bad("a04-unguarded-json-parse", ("src/server/{id}load.ts", "export function load(row) {\n  const v = JSON.parse(row.text);\n  return v;\n}")),
    *ok("a04-unguarded-json-parse", ("src/server/{id}load2.ts", "export function load(row) {\n  try {\n    return JSON.parse(row.text);\n  } catch (e) {\n    return null;\n  }\n}")),
    *bad("a04-unbounded-paid-loop", ("jobs/{id}enrich.py", "def main():\n    for row in rows:\n        client.messages.create(row)\n\nif __name__ == '__main__':\n    main()")),
    *bad("a04-unbounded-paid-loop",
         ("src/jobs/{id}embed.ts", "export async function embedAll(rows) {\n  for (const r of rows) {\n    await openai.embeddings.create(r);\n  }\n}"),
         ("src/jobs/{id}main.ts", "import { embedAll } from './{prev}embed';\nembedAll([]);")),
    *ok("a04-unbounded-paid-loop", ("jobs/{id}enrich2.py", "def main():\n    for row in rows[:10]:\n        client.messages.create(row)\n\nif __name__ == '__main__':\n    main()")),
    *bad("int-static-page-strict-csp",
         ("src/lib/{id}csp.ts", "export const csp = \"script-src 'strict-dynamic'\";"),
         ("src/app/{id}about/page.tsx", "export default function Page() {\n  return null;\n}")),
    *ok("int-static-page-strict-csp", ("src/app/{id}live/page.tsx", "export const dynamic = \"force-dynamic\";\nexport default function Page() {\n  return null;\n}")),
    *bad("a05-missing-security-headers",
         ("package.json", '{"name":"c","scripts":{"build":"x","test":"node tests/{id}a.test.mjs tests/{id}b.test.mjs tests/{id}c.test.mjs"},"dependencies":{"next":"^14.0.0"}}'),
         ("next.config.js", "module.exports = {\n  async headers() {\n    return [{ key: 'X-Frame-Options', value: 'DENY' }];\n  },\n};")),
    *bad("a05-cors-misconfiguration", ("src/server/{id}cors.ts", "res.setHeader('Access-Control-Allow-Origin', '*');")),
    *bad("a05-cors-misconfiguration", ("src/server/{id}cors2.ts", "res.setHeader('Access-Control-Allow-Origin', req.headers.origin);")),
    *ok("a05-cors-misconfiguration", ("src/server/{id}cors3.ts", "if (allowedOrigins.includes(origin)) {\n  res.setHeader('Access-Control-Allow-Origin', origin);\n}")),
    *bad("a05-build-config-health",
         ("src/lib/{id}present.ts", "export const b = 1;"),
         ("src/lib/{id}broken.ts", "import { a } from './nowhere{id}';\nimport { b } from '../lib/{prev}present';\nimport './{id}style.css';\nexport const k = process.env.UNDECLARED_FLAG;"),
         (".env.{id}.example", "ALERT_WEBHOOK=https://x.example\n"),
         ("tsconfig.json", '{"compilerOptions":{"strict": false}}')),
    *bad("a05-backup-cruft-tracked", ("src/lib/{id}old.ts.bak", "x")),
    Seed("cruft-local", "src/lib/{id}older.ts.orig", "x", ("a05-backup-cruft-tracked",), False),
    *bad("int-unbound-session-fallthrough", ("src/lib/{id}who.ts", "export async function resolveActor(req) {\n  const s = await readCookie(cookies());\n  if (s?.subjectKind === 'staff') return loadStaff(s);\n  return { id: 1, role: 'owner' };\n}")),
    *ok("int-unbound-session-fallthrough", ("src/lib/{id}who2.ts", "export async function resolveMember(req) {\n  const s = await readCookie(cookies());\n  if (!s?.subjectKind) return null;\n  if (s?.subjectKind === 'staff') return loadStaff(s);\n  return { id: 1, role: 'owner' };\n}")),
    *bad("int-gate-condition-too-broad", ("src/lib/{id}bootstrap.ts", "export async function openSetup() {\n  if (await hasAnyCredential()) return false;\n  return true;\n}\nexport async function hasAnyCredential() {\n  return store.count();\n}"),
         ("src/lib/{id}kinds.ts", "export const a = { kind: 'staff' };\nexport const b = { role: 'guest' };")),
    *bad("int-session-revoke-missing", ("src/lib/{id}accounts.ts", "export async function resetPassword(user) {\n  await store.setPassword(user);\n}\nexport function session() {\n  return 1;\n}")),
    *ok("int-session-revoke-missing", ("src/lib/{id}accounts2.ts", "export async function resetPassword(user) {\n  await store.setPassword(user);\n  await revokeAllSessions(user);\n  await destroySession(user);\n}")),
    *bad("a07-jwt-weak-verification", ("src/lib/{id}tok.ts", "export const opts = { alg: 'none' };")),
    *bad("a07-jwt-weak-verification", ("src/lib/{id}tok2.ts", "const claims = jwt.decode(raw);\nexport const role = claims.role;")),
    *bad("a07-jwt-weak-verification", ("src/lib/{id}tok3.ts", "jwt.verify(raw, key, { algorithms: ['HS256', 'RS256'], ignoreExpiration: true });")),
    *ok("a07-jwt-weak-verification", ("src/lib/{id}tok4.py", "claims = jwt.decode(raw, key, algorithms=['HS256'])\nrole = claims['role']")),
    *bad("a07-spoofable-client-ip", ("src/lib/{id}ip.ts", "export function ipOf(req) {\n  return req.headers.get('x-forwarded-for');\n}\nexport const throttle = 1;")),
    *ok("a07-spoofable-client-ip", ("src/lib/{id}ip2.ts", "export function ipOf(req) {\n  return req.headers.get('x-real-ip') || req.headers.get('x-forwarded-for');\n}\nexport const throttle = 1;")),
    *bad("a07-jwt-alg-none", ("src/lib/{id}ver.ts", "import { verify } from 'jsonwebtoken';\nexport const c = verify(raw, key, {\n  algorithms: [],\n});")),
    *bad("a07-weak-random-token", ("src/lib/{id}tokgen.ts", "const resetToken = Math.random().toString(36);")),
    *bad("a07-weak-random-token", ("src/lib/{id}tokgen2.ts", "const sessionToken = randomBytes(4).toString('hex');")),
    *ok("a07-weak-random-token", ("src/lib/{id}tokgen3.ts", "const resetToken = randomBytes(32).toString('hex');\nconst createdAt = Date.now();")),
    *bad("int-hand-enumerated-test-list",
         ("package.json", '{"name":"d","scripts":{"build":"x","test":"node tests/{id}a.test.mjs tests/{id}b.test.mjs tests/{id}c.test.mjs"}}'),
         ("tests/{id}forgotten.test.mjs", "check(1);")),
    *bad("int-generated-file-hand-edited",
         ("src/gen/{id}types.ts", "// generated by the schema tool, do not edit\nexport type A = number;"),
         ("tools/{id}emit.mjs", "writeFileSync('src/gen/{prev}types.ts', out);")),
    *ok("int-generated-file-hand-edited", ("src/gen/{id}other.ts", "// generated by hand once, do not edit\nexport type A = number;")),
    *bad("int-update-guard-without-delete", ("db/{id}guard.sql", "create trigger ledger{id}_immutable before update on ledger{id} for each row execute function stop();")),
    *ok("int-update-guard-without-delete", ("db/{id}guard2.sql", "create trigger ledger{id}_immutable before update or delete on ledger{id} for each row execute function stop();")),
    *bad("int-contract-two-writers",
         ("src/lib/{id}meta.ts", "export function put(shipmentState) {\n  writeFileSync('meta.json', JSON.stringify(shipmentState));\n}"),
         ("tools/{id}meta.mjs", "writeFileSync('meta.json', JSON.stringify(shipmentState));")),
    *bad("int-scan-after-write", ("src/lib/{id}upload.ts", "export async function take(f) {\n  await putObject(f);\n  await scanFile(f);\n}")),
    *ok("int-scan-after-write", ("src/lib/{id}upload2.ts", "export async function take(f) {\n  await scanFile(f);\n  await putObject(f);\n}")),
    *bad("a08-unverified-webhook", ("src/app/api/{id}stripe-webhook/route.ts", "export async function POST(r) {\n  console.log('stripe');\n  return apply(await r.json());\n}")),
    *ok("a08-unverified-webhook", ("src/app/api/{id}stripe-webhook2/route.ts", "export async function POST(r) {\n  console.log('stripe');\n  return stripe.webhooks.constructEvent(await r.text());\n}")),
    *bad("a08-external-script-no-sri", ("public/{id}index.html", '<html><script src="https://cdn.example.com/{id}.js"></script></html>')),
    *ok("a08-external-script-no-sri", ("public/{id}index2.html", '<html><script src="https://cdn.example.com/{id}.js" integrity="sha384-x"></script><script src="http://localhost/a.js"></script></html>')),
    *bad("a08-test-schema-divergence",
         ("app/{id}initdb.py", "def init_db(con):\n    con.execute('CREATE TABLE t (id int)')"),
         ("tests/{id}test_store.py", "def setup(con):\n    con.execute('CREATE TABLE t (id int)')")),
    *bad("int-pii-in-logs", ("src/lib/{id}audit.ts", "export function note(user) {\n  console.log('saved', user.email);\n}")),
    *ok("int-pii-in-logs", ("src/lib/{id}audit2.ts", "export function note(user) {\n  console.log('saved', mask(user.email), user.emailCount, user.customerId);\n}")),
    *bad("int-status-from-config-not-probe", ("src/lib/{id}stat.ts", "export function state() {\n  if (!process.env.MAIL_KEY) return 'off';\n  return 'connected';\n}")),
    *ok("int-status-from-config-not-probe", ("src/lib/{id}stat2.ts", "export async function state() {\n  if (!process.env.MAIL_KEY) return 'off';\n  await pingServer();\n  return 'connected';\n}")),
    *bad("int-hardcoded-status", ("src/lib/{id}health.ts", "export function report() {\n  return {\n    healthy: true,\n  };\n}")),
    *ok("int-hardcoded-status", ("src/lib/{id}health2.ts", "export async function report() {\n  await pingAll();\n  return {\n    healthy: true,\n  };\n}")),
    *bad("int-backup-without-restore-rehearsal", ("scripts/{id}backup.sh", "pg_dump app > nightly.sql")),
    *ok("int-backup-without-restore-rehearsal", ("scripts/{id}backup2.sh", "pg_dump app > nightly.sql\npg_restore nightly.sql")),
    *bad("int-alert-target-missing", ("src/lib/{id}watchdog.ts", "export function tick() {\n  return probeAll();\n}")),
    *ok("int-alert-target-missing", ("src/lib/{id}watchdog2.ts", "export function tick() {\n  return post(process.env.ALERT_WEBHOOK);\n}")),
    *bad("int-silent-budget-denial", ("src/lib/{id}judge.ts", "export async function judge(t) {\n  if (budgetLeft <= 0) return false;\n  return openai.chat.completions.create(t);\n}")),
    *ok("int-silent-budget-denial", ("src/lib/{id}judge2.ts", "export async function judge(t) {\n  skipped++;\n  if (budgetLeft <= 0) return false;\n  return openai.chat.completions.create(t);\n}")),
    *bad("a09-missing-audit-logging", ("src/app/api/{id}admin/route.ts", "export async function POST(r) {\n  await requireAdmin();\n  return 1;\n}")),
    *bad("a09-security-txt-missing", ("package.json", '{"name":"e","scripts":{"build":"x"},"devDependencies":{"vite":"^5.0.0"}}')),
    *bad("a09-swallowed-ddl-error", ("app/{id}migrate.py", "def up(con):\n    try:\n        con.execute('ALTER TABLE t ADD COLUMN x int')\n    except Exception:\n        pass\n")),
    *ok("a09-swallowed-ddl-error", ("app/{id}migrate2.py", "def up(con):\n    try:\n        con.execute('ALTER TABLE t ADD COLUMN x int')\n    except Exception:\n        raise\n")),
    *bad("a10-ssrf-user-controlled-request", ("src/app/api/{id}proxy/route.ts", "export async function GET(req) {\n  const target = req.query.url;\n  return fetch(target);\n}")),
    *ok("a10-ssrf-user-controlled-request", ("src/app/api/{id}proxy2/route.ts", "export async function GET(req) {\n  const target = req.query.url;\n  assertPublicUrl(target);\n  return fetch(target);\n}")),
    *bad("a10-ssrf-user-controlled-request", ("src/lib/{id}probe.ts", "export async function probe(place) {\n  return fetch(place);\n}")),
    *ok("a10-ssrf-user-controlled-request", ("src/lib/{id}fixed.ts", "const BASE = 'https://api.example.com';\nexport async function load(params) {\n  const u = `${BASE}/x?id=${params.id}`;\n  return fetch(u);\n}")),
    *bad("a07-weak-random-token", ("src/lib/{id}nonce.ts", "export function start() {\n  const loginNonce = Math.random();\n  return loginNonce;\n}")),
    *ok("a07-weak-random-token", ("src/lib/{id}times.ts", "export function start() {\n  const resetTime = Date.now();\n  return resetTime;\n}")),
    *bad("a01-mass-assignment", ("src/lib/{id}model.ts", "export async function add(req) {\n  return new UserModel(req.body);\n}")),
    # Values that take more than one step to a file.
    *bad("a01-path-traversal", ("src/app/api/{id}steps/route.ts", "import fs from 'fs';\nexport async function GET(req) {\n  const asked = req.query.name;\n  const full = join(base, asked);\n  let place = full;\n  return fs.readFile(place);\n}")),
    *bad("a01-path-traversal", ("src/app/api/{id}deep/route.ts", "import fs from 'fs';\nfunction load(root, place) {\n  return fs.readFile(place);\n}\nexport async function GET(req) {\n  const asked = req.query.name;\n  return load(base, asked);\n}")),
    *ok("a01-path-traversal", ("src/app/api/{id}safe/route.ts", "import fs from 'fs';\nexport async function GET(req) {\n  const asked = sanitizePath(req.query.name);\n  const place = asked;\n  return fs.readFile(place);\n}")),
    # Scopes that reach further than a window of lines or characters.
    *bad("a04-unguarded-json-parse", ("app/{id}read.py", "import json\n\ndef read(x):\n    try:\n        g(x)\n    except ValueError:\n        h(x)\n    return json.loads(x)")),
    *bad("a04-unguarded-json-parse", ("src/server/{id}each.ts", "export function each(rows) {\n  try {\n    rows.forEach((row) => {\n      use(JSON.parse(row));\n    });\n  } catch (e) {\n    return null;\n  }\n}")),
    *ok("a04-unguarded-json-parse", ("app/{id}read2.py", "import json\n\ndef read(x):\n    try:\n" + steps(50, "        x = step{i}(x)") + "        return json.loads(x)\n    except ValueError:\n        return None")),
    *ok("a04-unguarded-json-parse", ("src/server/{id}late.ts", "export function late(row) {\n  try {\n" + steps(50, "    row = step{i}(row);") + "    return JSON.parse(row);\n  } catch (e) {\n    return null;\n  }\n}")),
    *ok("int-session-revoke-missing", ("src/lib/{id}accounts3.ts", "export async function suspendMember(user) {\n" + steps(120, "  await store.write{i}(user, 'row');") + "  await invalidateSessions(user);\n}")),
    *bad("int-session-revoke-missing", ("src/lib/{id}accounts4.ts", "export async function suspendMember(user) {\n  await store.close(user);\n  helper();\n}\nexport async function other(user) {\n  await revokeAllSessions(user);\n}")),
    *ok("a01-server-action-auth-missing", ("src/app/{id}once/actions.ts", '"use server";\nexport async function useLink(id) {\n' + steps(60, "  await note.step{i}(id, 'seen');") + "  if (row.expires_at < now) return;\n  await prisma.item.delete({ where: { id } });\n}")),
    *bad("int-unbound-session-fallthrough", ("src/lib/{id}who3.ts", "export async function resolveOwner(req) {\n  const s = await readCookie(cookies());\n" + steps(90, "  trace.mark{i}(req, 'entered');") + "  if (s?.subjectKind === 'staff') return loadStaff(s);\n  return { id: 1, role: 'owner' };\n}")),
    *bad("a04-check-then-act-upsert", ("app/{id}upsert3.py", "def save(con, k):\n    row = con.execute('SELECT v FROM stock WHERE k = ?', (k,))\n" + steps(30, "    k = step{i}(k)") + "    def write():\n        return k\n    con.execute('UPDATE stock SET v = 1 WHERE k = ?', (k,))\n    con.execute('INSERT INTO stock VALUES (?, 1)', (k,))")),
    *ok("a04-check-then-act-upsert", ("app/{id}upsert4.py", "def look(con, k):\n    return con.execute('SELECT v FROM stock WHERE k = ?', (k,))\n\ndef save(con, k):\n    con.execute('UPDATE stock SET v = 1 WHERE k = ?', (k,))\n    con.execute('INSERT INTO stock VALUES (?, 1)', (k,))")),
    *bad("a04-unbounded-paid-loop", ("jobs/{id}enrich3.py", "def main():\n    for row in rows:\n" + steps(50, "        row = step{i}(row)") + "        client.messages.create(row)\n\nif __name__ == '__main__':\n    main()")),
    *ok("a04-unbounded-paid-loop", ("jobs/{id}enrich4.py", "def main():\n    for row in rows:\n        show(row)\n    client.messages.create(rows)\n\nif __name__ == '__main__':\n    main()")),
    Seed("plain", "docs/{id}readme.md", "Notes on the project.", ()),
    Seed("plain", "src/lib/{id}util.ts", "export const one = 1;\nexport function add(a, b) {\n  return a + b;\n}", ()),
]


def block_comment(path: str) -> bool:
    return path.endswith((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".sql"))


def takes_text(path: str) -> bool:
    """Files whose format has room for the document text."""
    return block_comment(path) or path.endswith((".md", ".html", ".sh"))


def seed_rows() -> list[tuple]:
    return [
        (i, s.path, s.body, "block" if block_comment(s.path) else "plain" if takes_text(s.path) else "none", s.tracked)
        for i, s in enumerate(SEEDS)
    ]


SEED_SCHEMA = "k int, path string, body string, mode string, tracked boolean"


def seeded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, path, content, tracked: one file per document."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    # The skeletons are fixed in this module: about a hundred and fifty short rows.
    seeds = F.broadcast(spark.createDataFrame(seed_rows(), SEED_SCHEMA))
    ident = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    joined = docs.withColumn("k", (F.col("doc_id") % len(SEEDS)).cast("int")).join(seeds, "k")
    text = F.replace(F.col("text"), F.lit("*/"), F.lit("* /"))
    before = F.concat(F.lit("d"), (F.col("doc_id") - 1).cast("string"))
    body = F.replace(F.replace(F.col("body"), F.lit("{id}"), ident), F.lit("{prev}"), before)
    content = (
        F.when(F.col("mode") == "block", F.concat(body, F.lit("\n/*\n"), text, F.lit("\n*/\n")))
        .when(F.col("mode") == "plain", F.concat(body, F.lit("\n"), F.col("text"), F.lit("\n")))
        .otherwise(body)
    )
    return joined.select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / FILES_PER_PROJECT).cast("string")).alias("project"),
        F.replace(F.col("path"), F.lit("{id}"), ident).alias("path"),
        content.alias("content"),
        "tracked",
        "doc_id",
    )


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def seeded_sql() -> str:
    """The same files in SQL, with the clean text known by construction.

    Skeletons hold no comment or prose string except the two generated banners, so
    the clean text is the body plus the blanked document text.
    """
    values = ",\n".join(f"({k}, {quote(p)}, {quote(b)}, '{m}', {str(t).lower()})" for k, p, b, m, t in seed_rows())
    return f"""
sf AS (
  SELECT 'p' || (doc_id // {FILES_PER_PROJECT}) AS project, replace(path, '{{id}}', 'd' || doc_id) AS path, tracked, doc_id, mode,
         replace(replace(body, '{{id}}', 'd' || doc_id), '{{prev}}', 'd' || (doc_id - 1)) AS body, text, replace(text, '*/', '* /') AS safe
  FROM documents JOIN (VALUES {values}) s(k, path, body, mode, tracked) ON k = doc_id % {len(SEEDS)}),
files AS (
  SELECT project, path, tracked, doc_id, mode,
    CASE mode WHEN 'block' THEN body || chr(10) || '/*' || chr(10) || safe || chr(10) || '*/' || chr(10)
              WHEN 'plain' THEN body || chr(10) || text || chr(10) ELSE body END AS content,
    CASE mode WHEN 'block' THEN regexp_replace(body, '(?m)^// generated[^\\n]*|new RegExp[(]"[^"]*"', '', 'g') || chr(10) || '  ' || chr(10)
                  || regexp_replace(safe, '[^\\n]', ' ', 'g') || chr(10) || '  ' || chr(10)
              WHEN 'plain' THEN body || chr(10) || text || chr(10) ELSE body END AS clean,
    regexp_matches(path, '(?i)(^|/)(__tests__|__mocks__|__fixtures__|tests?|spec|specs|fixtures?|e2e|cypress|playwright|stories)(/|$)')
      OR regexp_matches(path, '(?i)\\.(test|spec|stories|fixture|mock)\\.[jt]sx?$') AS is_test
  FROM sf),
cl AS (
  SELECT project, path, tracked, is_test, clean, unnest(l) AS text, generate_subscripts(l, 1) AS line_no
  FROM (SELECT *, string_split_regex(clean, '\\r?\\n') AS l FROM files))
"""
