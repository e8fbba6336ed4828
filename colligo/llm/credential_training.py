"""Trains the conditional random field of ``colligo.llm.credentials``.

``python -m colligo.llm.credential_training FOLDER…`` writes ``credential_weights.json``. Lines with and without credentials
are made from templates, in which ``«…»`` marks a credential and ``{name}`` a part that is drawn anew; lines of public source
code in the folders (the standard library of Python, script libraries) and lines of a small random grammar of programs count
as free of credentials. The lines that a first field labels wrongly are added for a second one. Training maximises the
conditional likelihood by AdaGrad with an L2 penalty; the marginals come from the forward–backward algorithm. Fixed seeds
make the result repeatable. Accuracy is told on templates that were held out whole.
"""

from __future__ import annotations

import base64
import json
import random
import re
import string
import sys
import uuid
from math import exp, log, sqrt
from pathlib import Path

from colligo.llm.credentials import Field, sentence_features, tokens

WORDS = "apple basket candle dragon engine forest garden harbor island jungle kettle ladder market needle ocean pepper quarry river saddle timber umbrella valley winter yellow zipper copper meadow falcon marble lantern rocket signal order batch cache ledger token session report window queue vector".split()
PASSWORD_NAMES = "password Password passwd pwd Pwd passphrase Passphrase PASSWORD db_password dbPassword user_password adminPassword smtp_password DB_PASS root_pwd".split()
TOKEN_NAMES = "token accessToken access_token authToken auth_token feedToken feed_token AUTH_TOKEN refreshToken bearer_token deployToken GITHUB_TOKEN apiToken".split()
KEY_NAMES = "apiKey api_key API_KEY ApiKey clientSecret client_secret webhookSecret webhook_secret signingKey signing_key SIGNING_KEY storageKey storage_key secretKey secret_key accessKey access_key privateKey encryptionKey sharedKey secret SECRET appSecret".split()
HEADERS = ["X-Api-Key", "PRIVATE-TOKEN", "X-Auth-Token", "Api-Key", "X-Access-Token", "apikey", "Ocp-Apim-Subscription-Key"]
ID_NAMES = "correlationId correlation_id clientId client_id requestId request_id traceId tenantId tenant_id buildId sessionId user_id instanceId".split()
HASH_NAMES = "checksum etag commit digest sha256 md5 revision hash integrity contentHash fingerprint".split()
SHOW = ["New password:", "Password", "txtPassword", "token expired", "Enter your API key", "password must not be empty", "Reset password", "invalid token", "auth failed", "key not found", "api key missing", "forgot password?", "password"]
PLACES = ["<your key>", "<your-api-key>", "YOUR_API_KEY_HERE", "YOUR_TOKEN", "xxxxxxxxxxxxxxxx", "xxxxxxxx", "********", "<redacted>", "{{secret}}", "{{ api_key }}", "<set at deploy>", "${DB_PASSWORD}", "${API_KEY}", "$(secret)", "changeme", "REPLACE_ME", "<password>", "...", "your-token-here", "%API_KEY%", "TODO", "***", "not set", "insert-key-here", "example-key", "dummy-token"]
ENV = ["DB_PASSWORD", "API_KEY", "FEED_TOKEN", "SECRET_KEY", "AUTH_TOKEN", "SMTP_PASSWORD", "APP_SECRET"]

PARTS = 5
#: Lines from templates, of the grammar and of public sources; hard lines added for the second field.
TEMPLATE_LINES, GRAMMAR_LINES, SOURCE_LINES, HARD_LINES = 12_000, 5_000, 6_000, 6_000
SOURCES = (".py", ".js", ".json", ".cs", ".ts", ".yaml", ".yml", ".md", ".java")


class Maker:
    """Lines from templates. Of every ``PARTS`` templates the last is held out: ``part`` False makes lines of the others only,
    True of those only, None of all."""

    def __init__(self, seed: int, part: bool | None = None):
        self.r, self.part = random.Random(seed), part

    def template(self, templates: list) -> str:
        return self.r.choice([t for i, t in enumerate(templates) if self.part is None or (i % PARTS == PARTS - 1) is self.part])()

    def chars(self, alphabet: str, low: int, high: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(low, high)))

    def word(self) -> str:
        return self.r.choice(WORDS)

    def leet(self, w: str) -> str:
        return w.translate(str.maketrans(self.r.choice(["aeo", "aei", "oes"]), self.r.choice(["430", "431", "053"]))) if self.r.random() < 0.9 else w

    def password(self) -> str:
        r, w, v = self.r, self.word(), self.word()
        return r.choice([
            lambda: w.capitalize() + str(r.randint(1, 2030)) + r.choice("!#%*@$"), lambda: w.capitalize() + str(r.randint(1, 99)) + r.choice(["x", "q", "", "z!"]),
            lambda: self.leet(w.capitalize()) + r.choice([".", "_", "!", "-", "#"]) + str(r.randint(1, 999)), lambda: w + v.capitalize() + r.choice(["!!", "77", "_x9", "%1", "#", "99", "$2"]),
            lambda: f"{r.choice(['push', 'open', 'move', 'send', 'fetch', 'merge', 'sort'])}-{w}-{v}{r.randint(1, 99)}", lambda: self.chars(string.ascii_letters + string.digits, 8, 16) + r.choice(["", "", "!", "#", "%"]),
            lambda: self.chars(string.ascii_letters, 7, 11) + r.choice("!#%*"), lambda: self.chars(string.ascii_letters + string.digits + "!#%*", 9, 14), lambda: w + str(r.randint(100, 9999)), lambda: self.chars(string.ascii_letters, 9, 13) + "_", lambda: w + v.capitalize() + str(r.randint(1, 99)),
        ])()

    def urlpass(self) -> str:
        return self.r.choice([lambda: self.chars(string.ascii_letters + string.digits, 8, 14), lambda: self.chars(string.ascii_uppercase + string.digits, 8, 14), lambda: self.word().capitalize() + str(self.r.randint(10, 9999)), lambda: self.leet(self.word()) + str(self.r.randint(10, 99))])()

    def token(self) -> str:
        r, an = self.r, string.ascii_letters + string.digits
        jwt = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
        return r.choice([
            lambda: self.chars(an, 20, 48), lambda: self.chars(string.ascii_lowercase + string.digits, 24, 36), lambda: self.chars("0123456789abcdef", 32, 32), lambda: self.chars("0123456789abcdef", 40, 40), lambda: str(uuid.UUID(int=r.getrandbits(128))),
            lambda: "ghp_" + self.chars(an, 36, 36), lambda: "sk_live_" + self.chars(an, 20, 26), lambda: "xoxb-" + self.chars(string.digits, 12, 12) + "-" + self.chars(an, 22, 26), lambda: "AKIA" + self.chars(string.ascii_uppercase + string.digits, 16, 16),
            lambda: r.choice(["npx_", "acme_live_", "glpat-", "pat_", "sb.", "key-", "tk_", "SG.", "dop_v1_"]) + self.chars(r.choice([an, an, string.ascii_letters]), 20, 32), lambda: base64.b64encode(r.randbytes(32)).decode(), lambda: base64.b64encode(r.randbytes(r.choice([20, 24, 30, 48, 64]))).decode(),
            lambda: jwt({"alg": "HS256", "typ": "JWT"}) + "." + jwt({"sub": self.word(), "n": r.randint(1, 999999)}) + "." + self.chars(an + "-_", 43, 43),
        ])()

    def pem(self, kind: str, newline: str) -> str:
        body = base64.b64encode(self.r.randbytes(self.r.randint(100, 400))).decode()
        rows = [body[i : i + 64] for i in range(0, len(body), 64)]
        return newline.join([f"-----BEGIN {kind}-----", *rows, f"-----END {kind}-----"])

    def name(self) -> str:
        w, v = self.word(), self.word()
        return self.r.choice([w + v.capitalize(), f"{w}_{v}", w, "_" + w + v.capitalize(), w + "0"])

    def hex_(self) -> str:
        n = self.r.choice([32, 40, 64])
        return self.chars("0123456789abcdef", n, n)

    def line(self) -> str:
        r = self.r
        q = r.choice(['"', '"', '"', "'"])
        decl = r.choice(["var ", "const ", "let ", "", "", "string ", "private const string ", "self.", "this.", "val ", "export ", "  "])
        end = r.choice([";", ";", "", ","])
        pn, tn, kn = r.choice(PASSWORD_NAMES), r.choice(TOKEN_NAMES), r.choice(KEY_NAMES)
        sn = r.choice([tn, kn])
        n = r.choice(["", "", "", "2", "_0", "_1", "_2"])
        w, v, svc = self.word(), self.word(), r.choice(["user_", "", "app_", "admin-", "bot_", "x_"]) + self.word()
        host = r.choice([f"{w}.example.invalid", f"db-{w}", f"{w}.internal:5432", f"{w}.example.com"])
        scheme = r.choice(["https", "amqp", "postgres", "ftp", "mysql", "redis", "mongodb", "http"])
        new = r.choice(["new ", "", "await ", "return "])
        m = lambda name: r.choice([name, name[0].upper() + name[1:], "".join("_" + c.lower() if c.isupper() else c for c in name)])
        secret = lambda: self.template([
            lambda: f"{decl}{pn}{n} = {q}«{self.password()}»{q}{end}", lambda: f"{r.choice(['options', 'config', 'settings', 'builder'])}.{pn} = {q}«{self.password()}»{q}{end}", lambda: f"{q}{pn}{n}{q}: {q}«{self.password()}»{q}{r.choice(['', ','])}",
            lambda: f"{r.choice(['', 'db_', 'smtp_', w + '_'])}{pn.lower()}{n}: «{self.password()}»", lambda: f"{pn.upper()}=«{self.password()}»",
            lambda: f"{decl}{sn}{n} = {q}«{self.token()}»{q}{end}", lambda: f"{q}{sn}{n}{q}: {q}«{self.token()}»{q}{r.choice(['', ','])}", lambda: f"{sn.lower()}{n}: {r.choice([q, q, ''])}«{self.token()}»" .replace("''", "") , lambda: f"{sn}{n}: {q}«{self.token()}»{q}",
            lambda: (lambda t, k: f"{decl}{sn}{n} = {q}«{t[:k]}»{q} + {q}«{t[k:]}»{q}{end}")(self.chars(string.ascii_letters + string.digits, 28, 40), r.randint(10, 20)),
            lambda: f"{r.choice(['headers', 'request.Headers', 'client.headers', 'http'])}.{m(r.choice(['add', 'set', 'append', 'setHeader']))}({q}{r.choice(HEADERS)}{q}, {q}«{self.token()}»{q}){end}",
            lambda: f"{r.choice(['request', 'client', 'req'])}.{m(r.choice(['setHeader', 'addHeader', 'header', 'set']))}({q}Authorization{q}, {q}{r.choice(['Bearer', 'token', 'Basic', 'Token', 'ApiKey'])} «{self.token()}»{q}){end}",
            lambda: f"{r.choice(['client', 'http', 'request'])}.{m(r.choice(['useBasicAuth', 'basicAuth', 'setBasicAuth', 'basic_auth']))}({q}«{base64.b64encode((svc + ':' + self.password()).encode()).decode()}»{q}){end}",
            lambda: f"{r.choice(['session', 'client', 'smtp', 'api', 'conn'])}.{m(r.choice(['login', 'authenticate', 'signIn', 'logon', 'connect']))}({q}{svc}{q}, {q}«{self.password()}»{q}){end}",
            lambda: f"{r.choice(['transport', 'channel', 'client'])}.{m(r.choice(['open', 'connect', 'dial']))}({q}{scheme}://{svc}:«{self.urlpass()}»@{host}/{v}{q}){end}", lambda: f"{r.choice(['url', 'dsn', 'feed', 'endpoint', 'mirror'])}{n}: {scheme}://{svc}:«{self.urlpass()}»@{host}/{v}", lambda: f"{q}{r.choice(['feed', 'url', 'mirror', 'proxy'])}{q}: {q}{scheme}://{svc}:«{self.urlpass()}»@{host}/v3{q}{r.choice(['', ','])}",
            lambda: f"{decl}conn = {new}{r.choice(['SqlConnection', 'DbConnection', 'Connection', 'connect'])}({q}Server={host};Database={v};{r.choice(['Uid', 'User Id', 'User'])}={svc};{r.choice(['Pwd', 'Password', 'pwd'])}=«{self.password()}»;{q}){end}",
            lambda: f"{q}connectionString{q}: {q}Endpoint=sb://{host}/;SharedAccessKeyName={r.choice(['root', 'all', 'send'])};SharedAccessKey=«{base64.b64encode(r.randbytes(32)).decode()}»{q}{r.choice(['', ','])}", lambda: f"{decl}conn = {q}AccountName={w};AccountKey=«{base64.b64encode(r.randbytes(64)).decode()}»;EndpointSuffix={host}{q}{end}",
            lambda: f"{r.choice(['command', 'args', 'run', 'cmd'])}{n}: {q}{r.choice(['deploy', 'sync', 'login', 'backup'])} --user {svc} --password «{self.chars(string.ascii_letters, 8, 11) if r.random() < 0.4 else self.password()}»{q}", lambda: f"{r.choice(['runner', 'process', 'shell', 'tool'])}.{m(r.choice(['start', 'run', 'exec']))}({q}--{r.choice(['token', 'secret', 'password', 'api-key'])}={'«' + self.token() + '»'}{q}, {q}{w}{q}){end}",
            lambda: f"{r.choice(['//', '#', '//', '--'])} {r.choice(['temporary login', 'staging account', 'test user', 'login for the demo:', 'credentials:', 'for now:', 'on the old box', 'use', 'sign in as', 'the demo runs as', 'shared with the team:'])} {svc} / «{self.password()}»",
            lambda: f"{decl}signer = Signer.{m('fromPem')}({q}«{self.pem(r.choice(['PRIVATE KEY', 'RSA PRIVATE KEY', 'EC PRIVATE KEY', 'OPENSSH PRIVATE KEY']), r.choice([chr(92) + 'n', chr(10)]))}»{q}){end}", lambda: f"«{self.pem(r.choice(['PRIVATE KEY', 'RSA PRIVATE KEY', 'EC PRIVATE KEY', 'OPENSSH PRIVATE KEY', 'ENCRYPTED PRIVATE KEY']), chr(10))}»",
            lambda: f"{kn} = {q * 3}«{self.pem(r.choice(['PRIVATE KEY', 'RSA PRIVATE KEY', 'EC PRIVATE KEY']), chr(10))}»{q * 3}",
            lambda: f"{pn} = {q}«{self.password()}»{q}  {r.choice(['#', '//'])} {w} {v}", lambda: f"{w}({q}{svc}{q}, {pn}={q}«{self.password()}»{q})", lambda: f"{w}({sn}={q}«{self.token()}»{q}, {v}=1){end}",
        ])
        decoy = lambda: self.template([
            lambda: f"{decl}{r.choice([pn, sn])}{n} = {q}{q}{end}", lambda: f"{decl}{r.choice([pn, sn])}{n} = {q}{r.choice(PLACES)}{q}{end}", lambda: f"{q}{r.choice([pn, sn])}{q}: {q}{r.choice(PLACES)}{q},", lambda: f"{r.choice([pn, sn]).lower()}: {r.choice(PLACES)}", lambda: f"{r.choice([pn, sn]).lower()}: {q}{r.choice(PLACES)}{q}",
            lambda: f"{decl}{r.choice([pn, sn])}{n} = {r.choice(['Environment.GetEnvironmentVariable', 'os.getenv', 'os.environ.get', 'System.getenv', 'env', 'config.get', 'settings.Get'])}({q}{r.choice(ENV)}{q}){end}", lambda: f"{decl}{r.choice([pn, sn])} = {r.choice(['process.env.', 'config.', 'settings.', 'Settings.', 'env.'])}{r.choice(ENV)}{end}", lambda: f"{decl}{r.choice([pn, sn])} = os.environ[{q}{r.choice(ENV)}{q}]",
            lambda: f"{decl}{r.choice([pn, sn])}{n} = {r.choice(['vault', 'secrets', 'keyring', 'store', 'provider'])}.{m(r.choice(['resolve', 'get', 'read', 'getSecret', 'fetch']))}({q}{w}-credentials{q}, {q}{r.choice(['password', 'token', 'value'])}{q}){end}",
            lambda: f"{decl}{r.choice(ID_NAMES)}{n} = {q}{uuid.UUID(int=r.getrandbits(128))}{q}{end}", lambda: f"{q}{r.choice(ID_NAMES)}{q}: {q}{uuid.UUID(int=r.getrandbits(128))}{q},", lambda: f"{decl}{r.choice(HASH_NAMES)}{n} = {q}{self.hex_()}{q}{end}", lambda: f"{r.choice(HASH_NAMES)}: sha256:{self.hex_()}", lambda: f"{decl}integrity = {q}sha384-{base64.b64encode(r.randbytes(48)).decode()}{q}{end}", lambda: f"{q}integrity{q}: {q}sha512-{base64.b64encode(r.randbytes(64)).decode()}{q}",
            lambda: f"{decl}{r.choice(['icon', 'image', 'logo', 'font'])}{n} = {q}data:image/png;base64,{base64.b64encode(r.randbytes(50)).decode()}{q}{end}", lambda: f"{decl}verifier = Verifier.{m('fromPem')}({q}{self.pem(r.choice(['PUBLIC KEY', 'RSA PUBLIC KEY', 'CERTIFICATE']), chr(92) + 'n')}{q}){end}",
            lambda: f"{r.choice(['form', 'ui', 'dialog', 'page'])}.{m(r.choice(['show', 'prompt', 'label']))}({q}{r.choice(SHOW)}{q}, {r.choice(['true', 'True'])}){end}", lambda: f"{r.choice(['_log.Write', 'console.log', 'log.info', 'logger.warn', 'print'])}({q}{w} {v} {r.choice(['is held', 'moved on', 'lags behind', 'token', 'expired'])}{q}, {q}{w}-{r.randint(1, 999)}{q}){end}",
            lambda: f"{decl}{self.name()} = {r.choice(['_', 'this.', 'self.', ''])}{self.name()}.{m(r.choice(['load', 'open', 'render', 'push']) + self.word().capitalize())}({self.name()}, {q}{w}-{r.randint(1, 999)}{q}, {r.randint(1, 9999)}){end}", lambda: f"{r.choice(['this.', 'self.', '_'])}{w}Token.{m('rotate' + v.capitalize())}({q}token-{r.randint(1, 999)}{q}, {self.name()}){end}", lambda: f"{w}_token_{r.randint(1, 99)}: {r.choice([v, 'true', 'false', str(r.randint(1, 9999))])}", lambda: f"token_{w}_{r.randint(1, 99)}: {r.choice([v, 'true', str(r.randint(1, 9999))])}", lambda: f"{q}token{q}: {r.randint(1, 999)},",
            lambda: f"{r.choice(['secretName', 'secret_name', 'secretRef', 'credentialsId'])}: {w}-{r.choice(['db-', ''])}credentials", lambda: f"{r.choice(['token_endpoint', 'auth_url', 'token_uri', 'login_url', 'authorization_endpoint'])}: {r.choice(['/oauth/token', '/login', f'https://{host}/oauth2/token', f'https://{host}/auth'])}", lambda: f"{r.choice(['key_file', 'private_key_path', 'password_file', 'tokenPath'])}: /etc/{w}/{v}.pem", lambda: f"{q}https://token.{host}{q},", lambda: f"{decl}url = {q}{scheme}://{host}/{w}/token{q}{end}", lambda: f"transport.open({q}{scheme}://{w}.example.invalid/{v}{q}){end}", lambda: f"url: {scheme}://{svc}:{r.choice(['${DB_PASSWORD}', '<password>', '****', '{{password}}', '%PASS%'])}@{host}/{v}",
            lambda: f"{r.choice(['//', '#', '///', ' *'])} {r.choice(['the password is read from the vault', 'see the token guide', 'Names are generated from the token id at run time.', 'reset the password with the admin tool', 'keys are sorted first', 'login uses the shared account', 'The vendor code comes first in the key.'])}", lambda: f"if ({r.choice([pn, tn])} == null) throw new Error({q}{w} {v}{q}){end}", lambda: f"if not {w}_name:", lambda: f"public async Task {m(w + 'Token')}(string {pn}0, Guid {w}1)", lambda: f"private readonly Token{w.capitalize()} _{v}{w.capitalize()};", lambda: f"const {w}Module = require({q}./{w}{q});", lambda: f"{decl}{r.choice(['passwordHash', 'password_hash', 'pwdHash'])} = {q}$2b$12${self.chars(string.ascii_letters + string.digits, 53, 53)}{q}{end}", lambda: f"{decl}publicKey = {q}{base64.b64encode(r.randbytes(32)).decode()}{q}{end}",
            lambda: f"{decl}{r.choice(['Payload', 'payload', 'Blob', 'iconBytes', 'ImageData', 'fontBase64', 'logo', 'DataBlob'])}{n} = {r.choice(['', 'b', '@'])}{q}{base64.b64encode(r.randbytes(r.choice([45, 90, 300, 1200]))).decode()}{q}{end}", lambda: f"static class {w.capitalize()}{v.capitalize()} {{ {r.choice(['internal', 'public'])} const string {r.choice(['Payload', 'Image', 'Blob'])} = {q}{base64.b64encode(r.randbytes(r.choice([60, 300, 1500]))).decode()}{q}; }}",
            lambda: f"{decl}keyId = {q}{w}-{v}-{r.randint(1, 99)}{q}{end}", lambda: f"{decl}user = {q}{svc}{q}{end}", lambda: f"session.{m('login')}({q}{svc}{q}, {r.choice([pn, 'password', tn])}){end}", lambda: f"headers.{m('add')}({q}{r.choice(HEADERS)}{q}, {r.choice([tn, 'token', kn])}){end}", lambda: f"headers.{m('add')}({q}X-Request-Id{q}, {q}{uuid.UUID(int=r.getrandbits(128))}{q}){end}", lambda: f"request.{m('setHeader')}({q}Authorization{q}, {q}Bearer {q} + {tn}){end}", lambda: f"{decl}{w}{v.capitalize()} = {q}{self.hex_()}{q}{end}", lambda: f"throw new {w.capitalize()}Exception({q}{v} token {w}{q}){end}", lambda: f"for (const token{v.capitalize()} of this.token{v.capitalize()}s) {{", lambda: f"{pn}: ${{{r.choice(ENV)}}}", lambda: f"{decl}{r.choice([pn, sn])} = Secret({q}{w}-{v}{q}){end}", lambda: f"{q}auth{q}: {{", lambda: f"{q}name{q}: {q}token-{w}{q},", lambda: f"name: {w}-token",
            lambda: f"{r.choice(['b', '', 'b', '@'])}{q}{base64.b64encode(r.randbytes(r.choice([36, 48, 57]))).decode()}{q}{r.choice(['', ',', ' +', ' ' + chr(92)])}", lambda: f"/*! {w} v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)} | (c) {w} authors | {r.choice(['MIT', 'BSD-3-Clause', 'Apache-2.0'])} | https://{w}.example.invalid */", lambda: f"// Copyright (c) the {w} authors. All rights reserved. Licensed under {r.choice(['MIT', 'Apache-2.0', 'GPL-3.0'])}.",
            lambda: "eval(function(p,a,c,k,e,d){while(c--){if(k[c]){p=p.replace(k[c])}}return p}(" + q + " ".join(self.chars(string.ascii_lowercase + string.digits, 2, 2) + "." + self.chars(string.ascii_lowercase + string.digits, 1, 1) for _ in range(r.randint(5, 30))) + q + ",36," + str(r.randint(1, 99)) + "," + q + "|".join(self.word() for _ in range(r.randint(5, 30))) + q + ".split(" + q + "|" + q + "),0,{}))",
            lambda: f"({q}token-{self.chars(string.ascii_lowercase + string.digits, 5, 5)}{q}, {r.randint(1, 99999)}),", lambda: "{ " + f"{q}id{q}: {r.randint(1, 99)}, {q}key{q}: {q}{w}-{self.chars(string.ascii_lowercase + string.digits, 4, 4)}{q}, {q}n{q}: {r.randint(1, 9999)}" + " },", lambda: f"{r.randint(0, 99)}: ({q}{r.choice(['token', w])}{q}, {r.randint(1, 9999)}, {r.random():.4f}),",
            lambda: f"function(){{a.{w}=function(l){{for(var s=0;s<l.length;s++)k(l[s],{r.randint(1, 9999)})}};void 0!==p.{v}&&(w=p.token({r.randint(1, 9999)}));b={{l:b,{w}:{q}{v}{q}}}}}", lambda: f"//# sourceMappingURL={w.capitalize()}Token{v.capitalize()}.js.map", lambda: f"// Upstream: https://{w}.example.invalid/src/{v.capitalize()}TokenFactory ({r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)})", lambda: f"// Vendored from {w} {r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)} (commit {self.chars('0123456789abcdef', 10, 10)}), no local patches.",
        ])
        indent = r.choice(["", "    ", "  ", "        "])
        return indent + (secret if r.random() < 0.55 else decoy)()


def sample(marked: str) -> tuple[str, list[tuple[int, int]]]:
    """The line without its marks, and the ranges that were marked."""
    text, spans, begin = [], [], 0
    for c in marked:
        if c == "«":
            begin = len(text)
        elif c == "»":
            spans.append((begin, len(text)))
        else:
            text.append(c)
    return "".join(text), spans


def gold(marked: str) -> tuple[list[list[str]], list[int]]:
    text, spans = sample(marked)
    cut = tokens(text)
    labels, last = [], -1
    for a, b, _ in cut:
        k = next((i for i, (x, y) in enumerate(spans) if a >= x - 1 and b <= y + 1 and min(b, y) > max(a, x)), -1)
        labels.append(0 if k < 0 else 2 if k == last else 1)
        last = k
    return sentence_features(cut, text), labels


def _log_sum(v: list[float]) -> float:
    m = max(v)
    return m + log(sum(exp(x - m) for x in v))


def train(lines: list[str], epochs: int = 6, rate: float = 0.25, penalty: float = 2e-5, seed: int = 5) -> Field:
    data = [gold(line) for line in lines]
    data = [d for d in data if d[0]]
    weights: dict[str, list[float]] = {}
    squares: dict[str, list[float]] = {}
    pairs, pair_squares = [[0.0] * 3 for _ in range(3)], [[1e-6] * 3 for _ in range(3)]
    model = Field(weights, pairs)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for feats, labels in data:
            n = len(feats)
            s = [model.scores(f) for f in feats]
            alpha = [s[0][:]]
            alpha[0][2] -= 50
            for k in range(1, n):
                alpha.append([s[k][y] + _log_sum([alpha[-1][x] + pairs[x][y] - (50 if x == 0 and y == 2 else 0) for x in range(3)]) for y in range(3)])
            beta = [[0.0] * 3 for _ in range(n)]
            for k in range(n - 2, -1, -1):
                beta[k] = [_log_sum([pairs[x][y] - (50 if x == 0 and y == 2 else 0) + s[k + 1][y] + beta[k + 1][y] for y in range(3)]) for x in range(3)]
            z = _log_sum(alpha[-1])
            for k in range(n):
                for y in range(3):
                    g = exp(min(0.0, alpha[k][y] + beta[k][y] - z)) - (labels[k] == y)
                    if abs(g) < 1e-3:
                        continue
                    for f in feats[k]:
                        w = weights.setdefault(f, [0.0] * 3)
                        q = squares.setdefault(f, [1e-6] * 3)
                        step = g + penalty * w[y]
                        q[y] += step * step
                        w[y] -= rate * step / sqrt(q[y])
                if k:
                    for x in range(3):
                        for y in range(3):
                            p = exp(min(0.0, alpha[k - 1][x] + pairs[x][y] - (50 if x == 0 and y == 2 else 0) + s[k][y] + beta[k][y] - z))
                            g = p - (labels[k - 1] == x and labels[k] == y)
                            if abs(g) > 1e-3:
                                pair_squares[x][y] += g * g
                                pairs[x][y] -= rate * g / sqrt(pair_squares[x][y])
    return model


def evaluate(model: Field, lines: list[str]) -> tuple[int, int, int, list[str]]:
    hit = missed = wrong = 0
    bad = []
    for line in lines:
        feats, labels = gold(line)
        got = model.viterbi(feats)
        hit += sum(1 for g, y in zip(got, labels) if g and y)
        m, w = sum(1 for g, y in zip(got, labels) if y and not g), sum(1 for g, y in zip(got, labels) if g and not y)
        missed, wrong = missed + m, wrong + w
        if m or w:
            bad.append(line)
    return hit, missed, wrong, bad


class Grammar:
    """Random lines of programs and data, none with a credential."""

    def __init__(self, seed: int):
        self.r, self.maker = random.Random(seed), Maker(seed + 1)

    def name(self) -> str:
        r, w = self.r, [self.maker.word() for _ in range(3)]
        return r.choice([w[0], w[0] + w[1].capitalize(), w[0].capitalize() + w[1].capitalize(), "_".join(w[:2]), "_" + w[0], w[0].upper() + "_" + w[1].upper(), r.choice(string.ascii_lowercase), w[0] + w[1].capitalize() + w[2].capitalize(), w[0] + str(r.randint(0, 99)), r.choice(TOKEN_NAMES + KEY_NAMES + PASSWORD_NAMES + ID_NAMES + HASH_NAMES)])

    def text(self) -> str:
        r = self.r
        words = " ".join(self.maker.word() for _ in range(r.randint(1, 5)))
        return r.choice([words, words.capitalize() + ".", f"{self.maker.word()}-{r.randint(0, 9999)}", "/" + words.replace(" ", "/"), f"{words.replace(' ', '.')}.{r.choice(['js', 'cs', 'py', 'json', 'io'])}", f"{{{self.name()}}}: {{0}} {words}", "%s " + words, f"v{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 99)}", f"20{r.randint(10, 40)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", words.replace(" ", "_"), words.title().replace(" ", ""), words.replace(" ", "-"), f"https://{words.split()[0]}.example.invalid/{words.split()[-1]}?n={r.randint(1, 99)}", r.choice(string.punctuation) * r.randint(1, 8)])

    def value(self, depth: int = 0) -> str:
        r = self.r
        q = r.choice("\"\"'")
        return r.choice([
            lambda: str(r.randint(0, 99999)), lambda: f"{r.random() * 100:.3f}", lambda: hex(r.getrandbits(r.choice([8, 32, 64]))), lambda: self.name(), lambda: self.name(), lambda: q + self.text() + q, lambda: q + self.text() + q, lambda: r.choice(["true", "false", "null", "None", "True", "undefined", "this", "self"]), lambda: f"{r.choice(['this', 'self', 'x', self.name()])}.{self.name()}",
            *([] if depth > 2 else [lambda: f"{self.name()}({', '.join(self.value(depth + 1) for _ in range(r.randint(0, 4)))})", lambda: f"{self.name()}.{self.name()}({', '.join(self.value(depth + 1) for _ in range(r.randint(0, 3)))})", lambda: f"{self.value(depth + 1)} {r.choice(['+', '-', '*', '/', '==', '===', '&&', '||', '??', '<', '%', '|', '<<', 'and', 'or', 'in', '=>'])} {self.value(depth + 1)}", lambda: f"[{', '.join(self.value(depth + 1) for _ in range(r.randint(0, 4)))}]", lambda: f"{self.name()}[{self.value(depth + 1)}]", lambda: f"{self.value(depth + 1)} ? {self.value(depth + 1)} : {self.value(depth + 1)}", lambda: f"new {self.name().capitalize()}<{self.name()}>({self.value(depth + 1)})", lambda: f"{{ {self.name()}: {self.value(depth + 1)}, {self.name()}: {self.value(depth + 1)} }}", lambda: f"await {self.name()}.{self.name()}({self.value(depth + 1)})"]),
        ])()

    def line(self) -> str:
        r, v, n = self.r, self.value, self.name
        end = r.choice([";", "", ";", ","])
        plain = lambda: r.choice([w for w in (n() for _ in range(4))])
        return r.choice(["", "  ", "    ", "        "]) + r.choice([
            lambda: f"{r.choice(['var', 'let', 'const', 'int', 'string', 'public static', ''])} {self.maker.name()} = {v()}{end}", lambda: f"{v()}{end}", lambda: f"if ({v()}) {{", lambda: f"if {v()}:", lambda: f"return {v()}{end}", lambda: f"case {v(3)}: return {v()};", lambda: f"for (var i = 0; i < {v(2)}; i++) {v()};", lambda: f"def {plain()}(self, {n()}, {n()}={r.randint(0, 9)}):", lambda: f"public {r.choice(['void', 'string', 'Task<int>'])} {n()}({n().capitalize()} {n()}, int {n()})", lambda: f"namespace {n().capitalize()}.{n().capitalize()};", lambda: f"import {{ {n()}, {n()} }} from '{self.maker.word()}/{self.maker.word()}'{end}", lambda: f"using {n().capitalize()}.{n().capitalize()};", lambda: f"{r.choice(['//', '#', '///', '*', '--'])} {self.text()} {self.text()}", lambda: f'"{self.maker.name()}": {r.randint(0, 99999)},', lambda: f'"{self.maker.name()}": "{self.text()}",', lambda: f"{self.maker.name()}: {self.text()}", lambda: f"- {self.text()}", lambda: r.choice("=<>#-*_~") * r.choice([3, 7, 7, 20, 40]), lambda: f"{'<' * 7} {r.choice(['HEAD', 'ours', self.maker.word()])}", lambda: f"{'>' * 7} {self.maker.word()}/{self.maker.word()}-{r.randint(1, 9999)}", lambda: "".join(f"{r.choice(['function', 'var', 'return', '!', ''])} {r.choice(string.ascii_letters)}{r.choice(['(', '=', '&&', '?', ':', ',', '||'])}{v(1)}{r.choice([')', ';', '', '}', ','])}" for _ in range(r.randint(2, 20))).replace(" ", r.choice(["", " "])), lambda: "| " + " | ".join(self.text() for _ in range(r.randint(2, 4))) + " |", lambda: ", ".join(v(3) for _ in range(r.randint(2, 12))) + end, lambda: f"<{self.maker.word()} {self.maker.word()}=\"{self.text()}\">{self.text()}</{self.maker.word()}>", lambda: f"{self.text()} {self.text()} {self.text()} {self.text()}", lambda: " ".join(r.choice("0123456789abcdef") + r.choice("0123456789abcdef") for _ in range(r.randint(4, 20))),
        ])()


def source_lines(folders: list[str]) -> list[str]:
    """Distinct lines of the source files below the folders, tests left out; those with a name of a credential and a quoted
    value beside it are left out as well, they may hold one."""
    doubtful = re.compile(r"(?i)(?:passw|pwd|secret|token|key|auth|login|credential)[\w\"'\]]*\s*(?:=|:|\(|,)\s*[\"'][^\"']|://[^\s/]+:[^\s/]+@|PRIVATE KEY")
    lines: dict[str, None] = {}
    for folder in folders:
        for path in sorted(Path(folder).rglob("*")):
            if path.suffix in SOURCES and not {"test", "tests", "idlelib", "site-packages"} & set(path.parts) and path.is_file():
                for line in path.read_text(errors="replace").split("\n"):
                    if 3 < len(line.strip()) and len(line) <= 2_000 and not doubtful.search(line):
                        lines.setdefault(line)
    return list(lines)


def hard(model: Field, lines: list[str]) -> list[str]:
    """Lines free of credentials on which the field sees one."""
    return [t for t in lines if any(model.viterbi(sentence_features(tokens(t), t)))]


def made(folders: list[str], part: bool | None) -> Field:
    maker, grammar, rng = Maker(11, part), Grammar(21), random.Random(31)
    sources = source_lines(folders)
    rng.shuffle(sources)
    short = [t for t in sources if len(t) <= 200]
    base = [maker.line() for _ in range(TEMPLATE_LINES)] + [grammar.line() for _ in range(GRAMMAR_LINES)] + short[:SOURCE_LINES]
    model = train(base, epochs=3)
    for turn in range(2):
        wrong = hard(model, short[SOURCE_LINES + turn * 60_000 : SOURCE_LINES + (turn + 1) * 60_000])[:HARD_LINES] + hard(model, [grammar.line() for _ in range(15_000)])[:HARD_LINES]
        print(f"turn {turn}: {len(wrong)} hard lines", *wrong[:: max(1, len(wrong) // 20)], sep="\n  ", file=sys.stderr)
        base += wrong
        model = train(base, epochs=3 if turn == 0 else 5)
    return model


def main() -> None:
    folders = sys.argv[1:]
    if "--held-out" in folders:
        folders.remove("--held-out")
        held = Maker(12, True)
        hit, missed, wrong, bad = evaluate(made(folders, False), [held.line() for _ in range(3000)])
        print(f"templates held out: {hit} tokens found, {missed} missed, {wrong} wrong", *bad[:40], sep="\n  ", file=sys.stderr)
        return
    model = made(folders, None)
    held = Maker(12)
    hit, missed, wrong, bad = evaluate(model, [held.line() for _ in range(3000)])
    print(f"other lines of the same templates: {hit} tokens found, {missed} missed, {wrong} wrong", *bad[:15], sep="\n  ", file=sys.stderr)
    kept = {f: [round(x, 2) for x in w] for f, w in sorted(model.weights.items()) if max(map(abs, w)) >= 0.1}
    Path(__file__).with_name("credential_weights.json").write_text(json.dumps({"pairs": [[round(x, 3) for x in p] for p in model.pairs], "weights": kept}, ensure_ascii=False, indent=0) + "\n")


if __name__ == "__main__":
    main()
