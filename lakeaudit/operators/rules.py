"""Source rules beside those of scan.RULES: weak code by language, each with a text that it finds and one that it doesn't.

Patterns keep to the syntax that Java, Python and RE2 share, and to one line. A rule's literals are what a content must hold
for it to match; the scan looks for all of them at once.
"""

from __future__ import annotations

from lakeaudit.operators.scan import Rule

_PY, _JS, _JAVA, _GO, _PHP, _RB, _CS, _C, _SH = ("python",), ("javascript", "typescript"), ("java", "kotlin"), ("go",), ("php",), ("ruby",), ("csharp",), ("c", "cpp"), ("shell",)

#: Id, languages, severity, weakness, pattern, literals, a text that it finds, a text that it doesn't.
TABLE = (
    ("py-eval", _PY, "high", "CWE-95", r"\beval\s*\(\s*[A-Za-z_]", ("eval",), "x = eval(code)", "x = literal_eval(code)"),
    ("py-exec", _PY, "high", "CWE-95", r"\bexec\s*\(\s*[A-Za-z_]", ("exec",), "exec(source)", "executor(source)"),
    ("py-os-system", _PY, "high", "CWE-78", r"\bos\.system\s*\(", ("os.system",), "os.system(cmd)", "pos.systems(cmd)"),
    ("py-os-popen", _PY, "medium", "CWE-78", r"\bos\.popen\s*\(", ("os.popen",), "os.popen(cmd)", "os.pipe()"),
    ("py-shell-true", _PY, "high", "CWE-78", r"\bsubprocess\.[a-zA-Z_]+\([^\n]*shell\s*=\s*True", ("subprocess.",), "subprocess.run(cmd, shell=True)", "subprocess.run(cmd, shell=False)"),
    ("py-pickle-load", _PY, "high", "CWE-502", r"\b(?:c?pickle|dill)\.loads?\s*\(", ("ickle.load", "dill.load"), "pickle.loads(raw)", "pickle.dumps(raw)"),
    ("py-marshal-load", _PY, "medium", "CWE-502", r"\bmarshal\.loads?\s*\(", ("marshal.load",), "marshal.load(f)", "marshal.dump(x, f)"),
    ("py-yaml-load", _PY, "high", "CWE-502", r"\byaml\.(?:load|load_all|unsafe_load)\s*\(\s*[A-Za-z_.()]+\s*\)", ("yaml.",), "yaml.load(text)", "yaml.safe_load(text)"),
    ("py-tls-verify-off", _PY, "high", "CWE-295", r"\bverify\s*=\s*False\b", ("verify",), "requests.get(url, verify=False)", "requests.get(url, verify=True)"),
    ("py-unverified-context", _PY, "high", "CWE-295", r"\bssl\._create_unverified_context\b", ("_create_unverified_context",), "ssl._create_unverified_context()", "ssl.create_default_context()"),
    ("py-weak-hash", _PY, "low", "CWE-327", r"\bhashlib\.(?:md5|sha1)\s*\(", ("hashlib.",), "hashlib.md5(x)", "hashlib.sha256(x)"),
    ("py-mktemp", _PY, "medium", "CWE-377", r"\btempfile\.mktemp\s*\(", ("tempfile.mktemp",), "tempfile.mktemp()", "tempfile.mkstemp()"),
    ("py-debug-server", _PY, "medium", "CWE-489", r"\.run\([^\n]*debug\s*=\s*True", (".run(",), "app.run(debug=True)", "app.run(debug=False)"),
    ("py-bind-all", _PY, "low", "CWE-605", r"\.bind\(\s*\(\s*[\"']0\.0\.0\.0[\"']", (".bind(",), "s.bind(('0.0.0.0', 80))", "s.bind(('127.0.0.1', 80))"),
    ("py-sql-format", _PY, "high", "CWE-89", r"\.execute\(\s*f[\"'][^\"'\n]*\{", (".execute(",), "c.execute(f'select {x}')", "c.execute('select ?', x)"),
    ("py-sql-percent", _PY, "high", "CWE-89", r"\.execute\(\s*[\"'][^\"\n]*[\"']\s*%", (".execute(",), "c.execute('select %s' % x)", "c.execute('select %s', x)"),
    ("py-etree", _PY, "low", "CWE-611", r"\bimport\s+xml\.etree|\bfrom\s+xml\.etree", ("xml.etree",), "import xml.etree.ElementTree", "import defusedxml.etree"),
    ("py-autoescape-off", _PY, "medium", "CWE-79", r"\bautoescape\s*=\s*False\b", ("autoescape",), "Environment(autoescape=False)", "Environment(autoescape=True)"),
    ("py-mark-safe", _PY, "medium", "CWE-79", r"\bmark_safe\s*\(", ("mark_safe",), "mark_safe(html)", "mark_safely = 1"),
    ("py-random-token", _PY, "low", "CWE-338", r"\b(?:token|secret|password)\w*\s*=\s*random\.", ("random.",), "token = random.random()", "value = random.random()"),
    ("py-assert-auth", _PY, "low", "CWE-617", r"\bassert\s+[a-z_.]*is_(?:admin|authenticated)\b", ("assert",), "assert user.is_admin", "if user.is_admin: pass"),
    ("py-tarfile-all", _PY, "medium", "CWE-22", r"\.extractall\s*\(", (".extractall",), "tar.extractall(p)", "tar.extractfile(p)"),
    ("py-jwt-unverified", _PY, "high", "CWE-347", r"[\"']verify_signature[\"']\s*:\s*False", ("verify_signature",), "jwt.decode(t, options={'verify_signature': False})", "{'verify_signature': True}"),
    ("py-paramiko-auto", _PY, "medium", "CWE-295", r"\bAutoAddPolicy\s*\(", ("AutoAddPolicy",), "c.set_missing_host_key_policy(AutoAddPolicy())", "RejectPolicy()"),
    ("js-eval", _JS, "high", "CWE-95", r"\beval\s*\(\s*[A-Za-z_$]", ("eval",), "eval(code)", "medieval(code)"),
    ("js-function-constructor", _JS, "high", "CWE-95", r"\bnew\s+Function\s*\(", ("Function",), "new Function('a', body)", "new FunctionTable('a')"),
    ("js-inner-html", _JS, "medium", "CWE-79", r"\.(?:inner|outer)HTML\s*\+?=\s*[A-Za-z_$]", ("HTML",), "el.innerHTML = text", "el.innerHTML = ''"),
    ("js-document-write", _JS, "medium", "CWE-79", r"\bdocument\.write(?:ln)?\s*\(", ("document.write",), "document.write(x)", "document.writable"),
    ("js-insert-html", _JS, "medium", "CWE-79", r"\.insertAdjacentHTML\s*\(", ("insertAdjacentHTML",), "e.insertAdjacentHTML('beforeend', x)", "e.insertAdjacentText('beforeend', x)"),
    ("js-dangerous-html", _JS, "medium", "CWE-79", r"\bdangerouslySetInnerHTML\b", ("dangerouslySetInnerHTML",), "<p dangerouslySetInnerHTML={{__html: x}}/>", "<p>{x}</p>"),
    ("js-child-exec", _JS, "high", "CWE-78", r"\bchild_process\b[^\n]*\bexec(?:Sync)?\s*\(", ("child_process",), "require('child_process').exec(cmd)", "require('child_process').execFile(cmd)"),
    ("js-timer-string", _JS, "medium", "CWE-95", r"\bset(?:Timeout|Interval)\s*\(\s*[\"']", ("setTimeout", "setInterval"), "setTimeout('go()', 1)", "setTimeout(go, 1)"),
    ("js-reject-unauthorized", _JS, "high", "CWE-295", r"\brejectUnauthorized\s*:\s*false\b", ("rejectUnauthorized",), "{rejectUnauthorized: false}", "{rejectUnauthorized: true}"),
    ("js-weak-hash", _JS, "low", "CWE-327", r"\bcreateHash\(\s*[\"'](?:md5|sha1)[\"']", ("createHash",), "crypto.createHash('md5')", "crypto.createHash('sha256')"),
    ("js-cipher-no-iv", _JS, "medium", "CWE-327", r"\bcrypto\.create(?:Cipher|Decipher)\s*\(", ("crypto.create",), "crypto.createCipher(a, k)", "crypto.createCipheriv(a, k, iv)"),
    ("js-sql-template", _JS, "high", "CWE-89", r"\.query\(\s*`[^`\n]*\$\{", (".query(",), "db.query(`select ${x}`)", "db.query(`select 1`)"),
    ("js-sql-concat", _JS, "high", "CWE-89", r"\.query\(\s*[\"'][^\"'\n]*[\"']\s*\+", (".query(",), "db.query('select ' + x)", "db.query('select ?', [x])"),
    ("js-cors-any", _JS, "low", "CWE-942", r"Access-Control-Allow-Origin[\"']\s*[,:]\s*[\"']\*", ("Access-Control-Allow-Origin",), "res.set('Access-Control-Allow-Origin', '*')", "res.set('Access-Control-Allow-Origin', 'https://a.example')"),
    ("js-post-message-any", _JS, "medium", "CWE-346", r"\.postMessage\([^\n]*,\s*[\"']\*[\"']", (".postMessage",), "w.postMessage(x, '*')", "w.postMessage(x, origin)"),
    ("js-local-storage-token", _JS, "low", "CWE-922", r"\blocalStorage\.setItem\(\s*[\"'][a-zA-Z_]*(?:token|jwt|password)", ("localStorage",), "localStorage.setItem('token', t)", "localStorage.setItem('theme', t)"),
    ("js-jwt-none", _JS, "high", "CWE-347", r"\balgorithms?\s*:\s*\[?\s*[\"']none[\"']", ("none",), "{algorithm: 'none'}", "{algorithm: 'HS256'}"),
    ("js-math-random-token", _JS, "low", "CWE-338", r"\b(?:token|secret|password)\w*\s*=\s*Math\.random", ("Math.random",), "token = Math.random()", "x = Math.random()"),
    ("js-proto-assign", _JS, "medium", "CWE-1321", r"\[[\"']__proto__[\"']\]\s*=", ("__proto__",), "o['__proto__'] = x", "o['proto'] = x"),
    ("java-runtime-exec", _JAVA, "high", "CWE-78", r"\bgetRuntime\(\)\.exec\s*\(", ("getRuntime",), "Runtime.getRuntime().exec(c)", "Runtime.getRuntime().gc()"),
    ("java-read-object", _JAVA, "high", "CWE-502", r"\.readObject\s*\(\s*\)", (".readObject",), "in.readObject()", "in.readObjects(1)"),
    ("java-statement-concat", _JAVA, "high", "CWE-89", r"\.execute(?:Query|Update)?\(\s*\"[^\"\n]*\"\s*\+", (".execute",), 's.executeQuery("select " + x)', 's.executeQuery("select 1")'),
    ("java-weak-digest", _JAVA, "low", "CWE-327", r"MessageDigest\.getInstance\(\s*\"(?:MD5|SHA-?1)\"", ("MessageDigest",), 'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")'),
    ("java-weak-cipher", _JAVA, "medium", "CWE-327", r"Cipher\.getInstance\(\s*\"(?:DES|RC4|[A-Za-z]+/ECB)", ("Cipher.getInstance",), 'Cipher.getInstance("AES/ECB/PKCS5Padding")', 'Cipher.getInstance("AES/GCM/NoPadding")'),
    ("java-hostname-any", _JAVA, "high", "CWE-295", r"\b(?:ALLOW_ALL_HOSTNAME_VERIFIER|NoopHostnameVerifier)\b", ("HOSTNAME_VERIFIER", "NoopHostnameVerifier"), "new NoopHostnameVerifier()", "new DefaultHostnameVerifier()"),
    ("java-random", _JAVA, "low", "CWE-338", r"\bnew\s+Random\s*\(\s*\)", ("Random",), "new Random()", "new SecureRandom()"),
    ("java-spring-csrf-off", _JAVA, "medium", "CWE-352", r"\.csrf\(\s*\)\s*\.disable\s*\(", (".csrf(",), "http.csrf().disable()", "http.csrf().and()"),
    ("java-print-stack", _JAVA, "info", "CWE-209", r"\.printStackTrace\s*\(\s*\)", (".printStackTrace",), "e.printStackTrace()", "e.getStackTrace()"),
    ("java-script-engine", _JAVA, "high", "CWE-95", r"\.getEngineByName\s*\(", ("getEngineByName",), 'm.getEngineByName("js")', "m.getEngineFactories()"),
    ("java-xml-factory", _JAVA, "low", "CWE-611", r"\b(?:DocumentBuilder|SAXParser|XMLInput)Factory\.newInstance\s*\(", ("Factory.newInstance",), "SAXParserFactory.newInstance()", "CipherFactory.newInstance()"),
    ("go-exec-shell", _GO, "high", "CWE-78", r"\bexec\.Command\(\s*\"(?:sh|bash)\"\s*,\s*\"-c\"", ("exec.Command",), 'exec.Command("sh", "-c", c)', 'exec.Command("ls", "-l")'),
    ("go-skip-verify", _GO, "high", "CWE-295", r"\bInsecureSkipVerify\s*:\s*true\b", ("InsecureSkipVerify",), "InsecureSkipVerify: true", "InsecureSkipVerify: false"),
    ("go-weak-hash", _GO, "low", "CWE-327", r"\b(?:md5|sha1)\.(?:New|Sum)\s*\(", ("md5.", "sha1."), "md5.New()", "sha256.New()"),
    ("go-sql-sprintf", _GO, "high", "CWE-89", r"\.(?:Query|Exec|QueryRow)\(\s*fmt\.Sprintf\(", ("fmt.Sprintf",), 'db.Query(fmt.Sprintf("select %s", x))', 'log.Print(fmt.Sprintf("x"))'),
    ("go-template-html", _GO, "medium", "CWE-79", r"\btemplate\.(?:HTML|JS|URL)\s*\(", ("template.",), "template.HTML(x)", "template.New(x)"),
    ("go-unsafe-pointer", _GO, "info", "CWE-242", r"\bunsafe\.Pointer\s*\(", ("unsafe.Pointer",), "unsafe.Pointer(&x)", "unsafe.Sizeof(x)"),
    ("go-math-rand", _GO, "low", "CWE-338", r"\"math/rand\"", ("math/rand",), 'import "math/rand"', 'import "crypto/rand"'),
    ("go-listen-all", _GO, "info", "CWE-605", r"\bnet\.Listen\(\s*\"tcp\"\s*,\s*\"(?:0\.0\.0\.0)?:", ("net.Listen",), 'net.Listen("tcp", ":80")', 'net.Listen("tcp", "127.0.0.1:80")'),
    ("php-eval", _PHP, "high", "CWE-95", r"\beval\s*\(\s*\$", ("eval",), "eval($x);", "evaluate($x);"),
    ("php-shell", _PHP, "high", "CWE-78", r"\b(?:shell_exec|passthru|system|popen)\s*\(\s*\$", ("shell_exec", "passthru", "system", "popen"), "system($cmd);", "filesystem($cmd);"),
    ("php-unserialize", _PHP, "high", "CWE-502", r"\bunserialize\s*\(\s*\$", ("unserialize",), "unserialize($x)", "serialize($x)"),
    ("php-include-var", _PHP, "high", "CWE-98", r"\b(?:include|require)(?:_once)?\s*\(?\s*\$_(?:GET|POST|REQUEST)", ("$_",), "include $_GET['p'];", "include 'a.php';"),
    ("php-sql-var", _PHP, "high", "CWE-89", r"\bmysqli?_query\([^\n]*\$_(?:GET|POST|REQUEST)", ("mysql",), 'mysql_query("select " . $_GET["x"])', "mysql_query($sql)"),
    ("php-echo-request", _PHP, "medium", "CWE-79", r"\becho\s+\$_(?:GET|POST|REQUEST|COOKIE)", ("echo",), "echo $_GET['a'];", "echo $safe;"),
    ("php-weak-hash", _PHP, "low", "CWE-327", r"\b(?:md5|sha1)\s*\(\s*\$(?:pass|pwd|password)", ("md5", "sha1"), "md5($password)", "md5($file)"),
    ("php-extract", _PHP, "medium", "CWE-621", r"\bextract\s*\(\s*\$_(?:GET|POST|REQUEST)", ("extract",), "extract($_POST);", "extract($row);"),
    ("ruby-eval", _RB, "high", "CWE-95", r"\b(?:instance_|class_)?eval\s*\(\s*params", ("eval",), "eval(params[:x])", "eval('1')"),
    ("ruby-system-interp", _RB, "high", "CWE-78", r"\bsystem\s*\(\s*\"[^\"\n]*#\{", ("system",), 'system("ls #{x}")', 'system("ls", x)'),
    ("ruby-marshal", _RB, "high", "CWE-502", r"\bMarshal\.load\s*\(", ("Marshal.load",), "Marshal.load(x)", "Marshal.dump(x)"),
    ("ruby-html-safe", _RB, "medium", "CWE-79", r"\.html_safe\b", (".html_safe",), "x.html_safe", "x.html_escape"),
    ("ruby-verify-none", _RB, "high", "CWE-295", r"\bVERIFY_NONE\b", ("VERIFY_NONE",), "OpenSSL::SSL::VERIFY_NONE", "OpenSSL::SSL::VERIFY_PEER"),
    ("ruby-where-interp", _RB, "high", "CWE-89", r"\.where\(\s*\"[^\"\n]*#\{", (".where(",), 'User.where("id = #{x}")', 'User.where("id = ?", x)'),
    ("csharp-binary-formatter", _CS, "high", "CWE-502", r"\bnew\s+BinaryFormatter\s*\(", ("BinaryFormatter",), "new BinaryFormatter()", "new JsonFormatter()"),
    ("csharp-sql-concat", _CS, "high", "CWE-89", r"\bnew\s+SqlCommand\(\s*\"[^\"\n]*\"\s*\+", ("SqlCommand",), 'new SqlCommand("select " + x)', 'new SqlCommand("select 1")'),
    ("csharp-cert-any", _CS, "high", "CWE-295", r"\bServerCertificateValidationCallback\b[^\n]*true", ("ServerCertificateValidationCallback",), "ServerCertificateValidationCallback = (a, b, c, d) => true", "ServerCertificateValidationCallback = Check"),
    ("csharp-weak-hash", _CS, "low", "CWE-327", r"\b(?:MD5|SHA1)\.Create\s*\(", (".Create",), "MD5.Create()", "SHA256.Create()"),
    ("csharp-process-start", _CS, "medium", "CWE-78", r"\bProcess\.Start\(\s*[a-z]", ("Process.Start",), "Process.Start(cmd)", 'Process.Start("a.exe")'),
    ("c-gets", _C, "high", "CWE-242", r"\bgets\s*\(", ("gets",), "gets(buf);", "fgets(buf, n, f);"),
    ("c-strcpy", _C, "medium", "CWE-120", r"\bstr(?:cpy|cat)\s*\(", ("strcpy", "strcat"), "strcpy(a, b);", "strlcpy(a, b, n);"),
    ("c-sprintf", _C, "medium", "CWE-120", r"\bv?sprintf\s*\(", ("sprintf",), "sprintf(a, f);", "snprintf(a, n, f);"),
    ("c-format-var", _C, "medium", "CWE-134", r"\bprintf\s*\(\s*[a-z_]+\s*\)", ("printf",), "printf(msg);", 'printf("%s", msg);'),
    ("c-system", _C, "high", "CWE-78", r"\bsystem\s*\(\s*[a-z_]", ("system",), "system(cmd);", 'system("ls");'),
    ("c-scanf-string", _C, "medium", "CWE-120", r"\bscanf\s*\(\s*\"[^\"\n]*%s", ("scanf",), 'scanf("%s", x);', 'scanf("%10s", x);'),
    ("c-alloca", _C, "low", "CWE-770", r"\balloca\s*\(\s*[a-z_]", ("alloca",), "alloca(n);", "alloca_size;"),
    ("c-mktemp", _C, "medium", "CWE-377", r"\b(?:mktemp|tmpnam)\s*\(", ("mktemp", "tmpnam"), "tmpnam(x);", "mkstemp(x);"),
    ("c-rand", _C, "low", "CWE-338", r"\bs?rand\s*\(\s*(?:time|\))", ("rand",), "srand(time(0));", "arc4random();"),
    ("sh-curl-pipe", _SH, "high", "CWE-494", r"\b(?:curl|wget)\b[^\n|]*\|\s*(?:sudo\s+)?(?:ba)?sh\b", ("curl", "wget"), "curl http://x | sh", "curl http://x | tar x"),
    ("sh-curl-insecure", _SH, "medium", "CWE-295", r"\bcurl\b[^\n]*\s(?:-k|--insecure)\b", ("curl",), "curl -k https://x", "curl https://x"),
    ("sh-chmod-all", _SH, "medium", "CWE-732", r"\bchmod\s+(?:-R\s+)?0?777\b", ("chmod",), "chmod 777 x", "chmod 755 x"),
    ("sh-eval-var", _SH, "high", "CWE-95", r"\beval\s+[\"']?\$", ("eval",), 'eval "$x"', "eval echo"),
    ("sh-rm-var", _SH, "medium", "CWE-73", r"\brm\s+-rf?\s+[\"']?\$[A-Za-z_{]+\}?/", ("rm",), "rm -rf $DIR/", "rm -rf build/"),
    ("sh-sudo-nopasswd", (), "medium", "CWE-250", r"\bNOPASSWD\s*:\s*ALL\b", ("NOPASSWD",), "x ALL=(ALL) NOPASSWD: ALL", "x ALL=(ALL) ALL"),
    ("http-basic-url", (), "low", "CWE-319", r"\bhttp://[A-Za-z0-9.-]+/(?:login|signin|auth)\b", ("http://",), "http://a.example/login", "https://a.example/login"),
    ("docker-root-user", ("docker",), "low", "CWE-250", r"(?:^|\n)USER\s+root\b", ("USER",), "USER root", "USER app"),
    ("docker-add-url", ("docker",), "low", "CWE-494", r"(?:^|\n)ADD\s+https?://", ("ADD",), "ADD http://x/y /y", "ADD y /y"),
    ("k8s-privileged", ("yaml",), "high", "CWE-250", r"\bprivileged\s*:\s*true\b", ("privileged",), "privileged: true", "privileged: false"),
    ("k8s-host-network", ("yaml",), "medium", "CWE-250", r"\bhost(?:Network|PID|IPC)\s*:\s*true\b", ("hostNetwork", "hostPID", "hostIPC"), "hostNetwork: true", "hostNetwork: false"),
    ("ci-pull-target", ("yaml",), "medium", "CWE-829", r"\bpull_request_target\b", ("pull_request_target",), "on: pull_request_target", "on: pull_request"),
    ("tf-open-ingress", ("terraform",), "medium", "CWE-284", r"\bcidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\"", ("cidr_blocks",), 'cidr_blocks = ["0.0.0.0/0"]', 'cidr_blocks = ["10.0.0.0/8"]'),
    ("tf-public-acl", ("terraform",), "high", "CWE-732", r"\bacl\s*=\s*\"public-read(?:-write)?\"", ("public-read",), 'acl = "public-read"', 'acl = "private"'),
)
SOURCE_RULES = tuple(Rule(name, pattern, severity, "source", languages, cwe=cwe, literals=literals) for name, languages, severity, cwe, pattern, literals, _, _ in TABLE)
