"""Every built-in rule fires where it is due and is silent where it must be."""

from siftline.operators import suppress
from siftline.plans.scan import Scanner
from siftline.sources.packs import Registry

EXT = {"java": "java", "javascript": "js", "python": "py", "go": "go"}
#: (rule, code it finds, code it leaves alone); | separates lines of a function's body.
CASES = [
    ("go.security.exec-command", 'exec.Command("ls")', "run(cmd)"),
    ("go.security.path-traversal", "os.Open(r.URL.Path)", 'os.Open("fixed.txt")'),
    ("go.security.weak-crypto", "md5.New()", "sha256.New()"),
    ("java.security.cookie-http-only", 'new Cookie("a", b);', "cookies.get(a);"),
    ("java.security.process-builder", "new ProcessBuilder(a);", "builder.start();"),
    ("java.security.runtime-exec", "Runtime.getRuntime().exec(cmd);", 'Runtime.getRuntime().exec("ls");'),
    ("javascript.security.child-process", 'require("child_process")', 'require("fs")'),
    ("javascript.security.document-write", "document.write(location.hash)", 'document.write("x")'),
    ("javascript.security.eval", "eval(x)", "evaluate(x)"),
    ("javascript.security.unsafe-innerhtml", "a.innerHTML = b", 'a.innerHTML = "b"'),
    ("javascript.security.open-redirect", "window.location.href = next", "go(next)"),
    ("javascript.security.path-traversal", "fs.readFile(req.path)", 'fs.readFile("a")'),
    ("javascript.security.weak-crypto", "createHash('md5')", "createHash('sha256')"),
    ("korea.java.code-injection", 'eval(request.getParameter("a"));', "evaluate(a);"),
    ("korea.java.comment-sensitive-info", "// password: abc", "// passes it on"),
    ("korea.java.debug-code", "System.out.println(a);", "log.info(a);"),
    ("korea.java.hardcoded-key", 'secret = "QUJDREVGR0hJSktMTU5P";', "secret = load();"),
    ("korea.java.hardcoded-password", 'password = "abc";', "password = read();"),
    ("korea.java.improper-exception", "catch (Exception e) { }", "catch (Exception e) { log(e); }"),
    ("korea.java.infinite-loop", "while (true) work();", "while (open) work();"),
    ("korea.java.insecure-certificate-validation", "boolean verify(String h) { return true; }", "boolean verify(String h) { return check(h); }"),
    ("korea.java.raw-socket", "new Socket(host, 80);", "factory.socket(host);"),
    ("korea.java.short-crypto-key", 'KeyGenerator.getInstance("AES").init(56);', 'KeyGenerator.getInstance("AES").init(256);'),
    ("korea.java.stacktrace-public", "e.printStackTrace();", "log.error(e);"),
    ("korea.java.toctou", "if (f.exists()) f.go();", "f.go();"),
    ("korea.java.unsafe-api", "System.gc();", "pool.collect();"),
    ("korea.java.unsafe-deserialization", "in.readObject();", "in.readLine();"),
    ("korea.java.unsigned-code-download", "new URLClassLoader(u);", "loader.find(u);"),
    ("korea.java.weak-crypto-algorithm", 'Cipher.getInstance("DES");', 'Cipher.getInstance("AES/GCM/NoPadding");'),
    ("korea.java.weak-random", "new Random();", "new SecureRandom();"),
    ("korea.java.weak-signature", 'Signature.getInstance("SHA1withRSA");', 'Signature.getInstance("SHA256withRSA");'),
    ("korea.java.xxe", "DocumentBuilderFactory.newInstance();", 'DocumentBuilderFactory.newInstance().setFeature("disallow-doctype-decl", true);'),
    ("korea.js.command-injection", "child_process.exec('ls ' + d)", "child_process.exec('ls')"),
    ("korea.js.debug-code", "console.log(a)", "logger.info(a)"),
    ("korea.js.error-message-info", "res.send(err.stack)", "res.send(err.code)"),
    ("korea.js.improper-exception", "catch (e) { }", "catch (e) { log(e) }"),
    ("korea.js.infinite-loop", "while (true) work()", "while (open) work()"),
    ("korea.js.ldap-injection", "client.search('cn=' + name)", "client.search(base)"),
    ("korea.js.path-traversal", "fs.unlink(request)", 'fs.unlink("a")'),
    ("korea.js.sql-injection", "db.query(`select ${id}`)", "db.query('select 1')"),
    ("korea.js.ssrf", "fetch(`http://${h}`)", 'fetch("http://a")'),
    ("korea.js.weak-crypto", "createHash('sha1')", "createHash('sha512')"),
    ("korea.js.weak-random", "Math.random()", "crypto.randomInt(9)"),
    ("korea.js.xss-react", "dangerouslySetInnerHTML", "textContent"),
    ("korea.js.xxe", "new DOMParser()", "new Parser()"),
    ("korea.py.debug-code", "print(x)", "log(x)"),
    ("korea.py.error-message-info", "traceback.print_exc()", "logger.exception(e)"),
    ("korea.py.improper-exception", "except ValueError: pass", "except ValueError: raise"),
    ("korea.py.infinite-loop", "while True: go()", "while busy: go()"),
    ("korea.py.plaintext-transport", "requests.get('http://a')", "requests.get('https://a')"),
    ("korea.py.sql-injection", "c.execute('select ' + x)", "c.execute('select 1')"),
    ("korea.py.toctou", "os.path.exists(p)", "p.stat()"),
    ("korea.py.unsafe-deserialization", "marshal.loads(x)", "json.loads(x)"),
    ("korea.py.weak-crypto", "hashlib.md5(x)", "hashlib.sha3_256(x + s)"),
    ("korea.py.weak-random", "random.randint(1, 2)", "secrets.randbelow(2)"),
    ("korea.py.xxe", "import lxml.etree", "import defusedxml"),
    ("python.security.eval-exec", "eval(request.body)", "evaluate(request.body)"),
    ("python.security.os-system", "os.system(x)", "subprocess.run([x])"),
    ("python.security.pickle", "pickle.loads(x)", "json.loads(x)"),
    ("python.security.ssti", "render_template_string(request.body)", "render_template('a.html')"),
    ("python.security.subprocess-shell", "subprocess.run(x, shell=True)", "subprocess.run([x])"),
    ("python.security.weak-crypto", "hashlib.sha1(x)", "hashlib.sha3_512(x + s)"),
    ("python.security.yaml-unsafe-load", "yaml.load(x)", "yaml.load(x, Loader=SafeLoader)"),
    ("korea.py.unsalted-hash", "hashlib.sha256(p)", "hashlib.sha256(p + salt)"),
    ("korea.java.reflection", "void f() { Class.forName(n); }", 'void f() { Class.forName("a.B"); }'),
    ("go.security.sql-injection", 'func h(r *R) { db.Query("a" + r.FormValue("x")) }', 'func h(r *R) { db.Query("a") }'),
    ("go.security.ssrf", 'func h(r *R) { http.Get(r.FormValue("x")) }', 'func h(r *R) { http.Get("http://a") }'),
    ("java.security.command-injection", 'void f(R r) { sh.exec(r.getParameter("x")); }', 'void f(R r) { sh.exec("ls"); }'),
    ("java.security.path-traversal", 'void f(R r) { new File(r.getParameter("x")); }', 'void f(R r) { new File("a"); }'),
    ("java.security.spring-sql-jdbc-template", "void f(@PathVariable String id) { jdbcTemplate.query(id + a); }", "void f(String id) { jdbcTemplate.query(id + a); }"),
    ("java.security.sql-injection", 'void f(R r) { st.executeQuery(a + r.getParameter("x")); }', 'void f(R r) { st.executeQuery("select 1"); }'),
    ("java.security.ssrf", 'void f(R r) { new URL(r.getHeader("x")); }', 'void f(R r) { new URL("http://a"); }'),
    ("java.security.xss-response", 'void f(R r) { w.getWriter().write(r.getParameter("x")); }', 'void f(R r) { w.getWriter().write("a"); }'),
    ("korea.java.http-response-splitting", 'void f(R r) { w.setHeader("a", r.getParameter("x")); }', 'void f(R r) { w.setHeader("a", "b"); }'),
    ("korea.java.ldap-injection", 'void f(R r) { c.search(r.getParameter("x")); }', 'void f(R r) { c.search("a"); }'),
    ("korea.java.open-redirect", 'void f(R r) { w.sendRedirect(r.getParameter("x")); }', 'void f(R r) { w.sendRedirect("/a"); }'),
    ("korea.js.xss", "function f(req, res) { res.write(req.query.a) }", "function f(req, res) { res.write('a') }"),
    ("korea.py.path-traversal", "open(request.args['a'])", "open('a')"),
    ("korea.py.xss", "mark_safe(request.GET['a'])", "mark_safe('a')"),
    ("python.security.ssrf", "requests.get(request.args['a'])", "requests.get(fixed)"),
]


def test_every_rule_fires_and_rests(spark):
    rules = {r.id: r for r in Registry.built_in().rules}
    assert sorted(c[0] for c in CASES) == sorted(rules)
    rows = []
    for i, (rule, bad, good) in enumerate(CASES):
        language = rules[rule].languages[0]
        mark = "#" if language == "python" else "//"
        wrap = ("class A {\n", "}\n") if language == "java" else ("package m\n", "") if language == "go" else ("", "")
        text = f"{wrap[0]}{mark} ruleid: {rule}\n{bad}\n\n{mark} ok: {rule}\n{good}\n{wrap[1]}"
        if language == "python" and "except" in bad:
            text = f"try: go()\n{mark} ruleid: {rule}\n{bad}\ntry: go()\n{mark} ok: {rule}\n{good}\n"
        rows.append((i, f"{rule}.{EXT[language]}", language, text))
    files = spark.createDataFrame(rows, "file_id long, path string, language string, text string")
    found = Scanner(spark).findings(files)
    wrong = suppress.verdicts(suppress.annotations(files), found, list(rules)).collect()
    assert [(v.kind, v.rule_id, v.line) for v in wrong] == []
