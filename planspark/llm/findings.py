"""Labelled findings that teach the secret scan's forest: lines written by us, filled with random values by rule.

A line is ``label | topic | path | text``; ``«kind»`` stands for a value of that kind. In lines with label 1 the
longest value is the secret, and candidates that neither hold it nor lie in it are false positives. Every line is
filled COPIES times, so there are some thousands of findings, whatever the size of the corpus. When the
forest is measured, all fillings of a line are kept aside together: its wording is new to the forest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COPIES = 24

LINES = """
1|password|src/settings.py|password = "«mixed20»"
1|password|conf/app.ini|password=«hex24»
1|password|src/db.js|const dbPassword = '«marked»';
1|password|notes/todo|remember the password: «marked» and change it
1|password|mail/archive|Your new password is «mixed12» , please log in
1|password|conf/prod.yaml|  admin_password: «letters16»
1|url|src/db.py|connect("postgres://app:«mixed20»@db.internal:5432/main")
1|url|deploy/run.sh|curl https://deploy:«hex40»@git.internal/repo.git
1|token|src/app.py|token = "«hex40»"
1|token|web|blah token = "«hex40»" and then more of the text
1|token|forum|here is my token «hex40» that stopped working
1|token|src/client.ts|headers: { Authorization: "Bearer «base43»" }
1|token|ci/build.yml|GITHUB_TOKEN: ghp_«mixed36»
1|token|chat|use glpat-«mixed20» for now
1|token|src/bot.py|SLACK = "xoxb-«digits12»-«mixed24»"
1|key|src/aws.py|aws_access_key_id = AKIA«upper16»
1|key|infra/main.tf|secret_key = "«base40»"
1|key|web|my aws secret key is «base40» please rotate
1|key|docs/setup.md|export API_KEY=«hex32»
1|key|app/config.json|{"api_key": "«mixed32»", "region": "eu"}
1|key|src/pay.rb|Stripe.api_key = 'sk_live_«mixed24»'
1|key|src/map.js|key=AIza«mixed35»
1|key|conf/private.env|PRIVATE_KEY=«base64»
1|secret|conf/oauth.yml|client_secret: «mixed32»
1|secret|src/jwt.go|var jwtSecret = []byte("«base43»")
1|secret|forum|the shared secret «mixed24» was posted by mistake
1|secret|conf/session.php|'secret' => '«hex64»',
1|credentials|.netrc|machine git.internal login bot password «mixed20»
1|credentials|src/auth.py|auth = ("service", "«mixed16»")
1|credentials|deploy/secrets.env|DB_CREDENTIALS=service:«marked»
0|number|web|call +1 (555) 555-«digits4» today
0|number|mail/archive|phone 0«digits10» or write to us
0|number|shop|card number «digits16» was declined
0|number|shop|order «digits12» has been sent
0|number|shop|invoice «digits8»-«digits4» is due
0|number|web|the total of «digits10» readers in all
0|number|bank|account DE«digits20» at the bank
0|number|web|«digits16» of the
0|number|web|call 555-«digits4» now
0|number|lab|sample «digits6»-«digits3»-A1 was read
0|number|web|ticket «digits10» is closed
0|date|log/app.log|20«digits2»-05-12T10:44:«digits2»Z started
0|date|web|on 12/05/20«digits2» the
0|date|backup|backup-20«digits6»-full
0|commit|docs/changes.md|fixed in commit «hex40»
0|commit|git/log|Merge «hex8» into «hex8»
0|digest|requirements/lock.txt|sha256:«hex64»
0|digest|package-lock.json|"integrity": "sha512-«base86»==",
0|digest|docs/release.md|md5 checksum «hex32»
0|digest|go.sum|h1:«base43»=
0|digest|web|etag: "«hex32»"
0|digest|repo/index.json|"sha1": "«hex40»",
0|digest|dist/SHASUMS|checksum=«hex64»
0|digest|web/page.html|integrity="sha384-«base64»"
0|digest|Pipfile.lock|"sha256:«hex64»",
0|identifier|api/log|cursor=«base40»
0|identifier|web|/watch/«mixed11»
0|identifier|web|?id=«mixed16»&page=«digits2»
0|identifier|api/data.json|"id": "«mixed24»",
0|identifier|web|doi 10.«digits4»/«word».«digits6»
1|token|mail/archive|your access token: «mixed40»
1|token|src/run.sh|--token «hex40» --verbose
1|password|chat|user admin pass «mixed12»
1|password|src/config.go|Password: "«letters16»",
1|key|chat|new API key «mixed32» works
0|identifier|web|id «hex8»-«hex4»-«hex4»-«hex4»-«hex12» of the record
0|identifier|src/model.py|uuid = "«hex8»-«hex4»-«hex4»-«hex4»-«hex12»"
0|identifier|log/app.log|request_id=«hex32» took 12 ms
0|identifier|log/app.log|trace «hex16» span «hex16»
0|link|web|https://example.org/a/«hex16»/index.html
0|link|web|see http://example.org/2019/05/«word»-«word»-«digits6»
0|link|web|watch?v=«mixed11»
0|mail|web|write to «word»«digits4»@mail.example.com please
0|mail|web|«word».«word»«digits2»@example.org
0|place|src/readme|open /usr/lib/«word»64/lib«word»2.so
0|place|web|static/«word».«hex20».min.js
0|placeholder|docs/setup.md|api_key = "your_api_key_«digits2»"
0|placeholder|tests/test_app.py|password = "changeme«digits3»"
0|placeholder|docs/example.env|TOKEN=xxxxxxxx«digits2»
0|placeholder|examples/config.yml|secret: example-secret-«digits3»
0|placeholder|tests/fixtures/auth.json|{"token": "test-token-«digits4»"}
0|placeholder|docs/guide.md|export API_KEY=<insert-key-«digits2»>
0|reference|src/app.py|password = os.environ["DB_PASSWORD_«digits2»"]
0|reference|deploy/app.yaml|token: ${CI_JOB_TOKEN_«digits2»}
0|reference|src/app.js|const token = getToken2(user«digits2»)
0|word|web|the «word»«digits2»«word» was «word»
0|word|web|«word»_«word»_«digits3» and «word»-«word»-«digits2»
0|word|src/app.py|self.«word»_«word»_«digits2» = «word»_«word»«digits1»
0|word|web|a password of «digits1»0-characters2 is long
0|word|web|token ring 802-«digits4»
0|word|web|key stage-«digits1»-lessons
0|word|forum|secret agent «word»007-«word»
0|word|blog|top-«digits2»-«word»-«word»
0|picture|web/page.html|src="data:image/png;base64,iVBORw0KGgo«base64»"
0|picture|style/site.css|background:#«hex6»aa url(img«digits4»/«word»)
0|version|docs/changes.md|release v«digits1».«digits2».0-beta«digits1»-build«digits4»
0|version|web|model XK-«digits4»-«upper4»
""".strip()  # fmt: skip

WORDS = ["report", "table", "window", "garden", "paper", "market", "winter", "letter", "number", "people", "river", "summer", "street", "school", "silver", "engine"]


def _value(kind: Column, salt: Column) -> Column:
    """A value of the kind (a name and, but for marked and word, a length), drawn by the hash of salt."""
    name, size = F.regexp_extract(kind, "^[a-z]+", 0), F.coalesce(F.try_to_number(F.regexp_extract(kind, "[0-9]+$", 0), F.lit("999")).cast("int"), F.lit(0))
    hexed = F.concat(F.sha2(salt, 512), F.sha2(F.concat(salt, F.lit("+")), 512))
    based = F.translate(F.base64(F.unhex(hexed)), "=\r\n", "")
    plain = F.translate(based, "+/", "aZ")
    whole = (
        F.when(name == "hex", hexed).when(name == "base", based).when(name == "mixed", plain).when(name == "upper", F.upper(plain))
        .when(name == "letters", F.translate(plain, "0123456789", "hJkRtYuPsD")).otherwise(F.concat(F.translate(F.substring(hexed, 1, 1), "0abcdef", "1234567"), F.translate(F.substring(hexed, 2, 99), "abcdef", "123456")))
    )
    marked = F.concat(F.substring(plain, 1, 5), F.lit("#"), F.substring(plain, 6, 4), F.lit("!"), F.substring(hexed, 3, 3))
    word = F.get(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64(salt), F.lit(len(WORDS))).cast("int"))
    return F.when(name == "marked", marked).when(name == "word", word).otherwise(F.substring(whole, F.lit(1), size))


def labelled_texts(spark: SparkSession, copies: int = COPIES) -> DataFrame:
    """doc_id, path, text, label, topic, secret, place: every line (its place) filled ``copies`` times; secret is null where label is 0."""
    line = F.split("line", "\\|", 4)
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(LINES), "\n")).alias("at", "line"))
    rows = rows.select("at", line[0].cast("double").alias("label"), line[1].alias("topic"), line[2].alias("path"), F.split(line[3], "[«»]").alias("parts"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    salt = F.concat_ws(":", F.col("at").cast("string"), F.col("copy").cast("string"))
    # every second part is a kind
    parts = F.transform("parts", lambda x, i: F.when(i % 2 == 1, _value(x, F.concat_ws(":", salt, i.cast("string")))).otherwise(x))
    rows = rows.select("*", parts.alias("filled"))
    values = F.array_sort(F.filter("filled", lambda x, i: i % 2 == 1), lambda a, b: F.length(b) - F.length(a))
    secret = F.when(F.col("label") == 1, F.get(values, F.lit(0)))
    return rows.select((F.col("at") * copies + F.col("copy")).cast("long").alias("doc_id"), "path", F.array_join("filled", "").alias("text"), "label", "topic", secret.alias("secret"), F.col("at").alias("place"))
