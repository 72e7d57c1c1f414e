"""The shipped rules, by class of weakness and language.

Names are canonical, ``<lang>:<module>.<member>``. A class lists its sinks for each
language; what comes in from outside and what passes text on are the same for all
classes of a language."""

from __future__ import annotations

SOURCES = {
    "python": ["py:input", "py:flask.request.*", "py:django.http.*.GET.*", "py:os.environ.get", "py:sys.argv*", "py:@http.param"],
    "go": ["go:@net/http.Request", "*http.Request*.FormValue", "*http.Request*.PostFormValue", "*url.Values*.Get", "*gin.Context*.Query", "*gin.Context*.Param", "*echo.Context*.QueryParam", "go:os.Getenv"],
    "javascript": ["js:req.*", "js:request.*", "js:ctx.query*", "js:ctx.params*", "js:process.argv*", "js:location.*", "js:document.URL"],
    "java": ["*HttpServletRequest.getParameter*", "*HttpServletRequest.getHeader*", "*HttpServletRequest.getQueryString*", "java:@RequestParam", "java:@PathVariable", "java:@QueryParam"],
    "ruby": ["ruby:params*", "ruby:request.*", "ruby:cookies*", "ruby:gets"],
    "rust": ["rust:std::env::args*", "rust:axum::extract::*", "rust:actix_web::web::*", "rust:std::io::stdin*"],
    "c": ["c:argv", "cpp:argv", "c:getenv", "c:fgets", "c:read", "c:recv"],
}
PASSING = {
    "python": ["*.format", "*.join", "*.strip", "*.lower", "*.upper", "*.replace", "*.encode", "*.decode", "*.split", "py:str", "py:os.path.join", "py:urllib.parse.*"],
    "go": ["go:fmt.Sprint*", "go:strings.*", "go:path.Join", "go:path/filepath.Join", "go:net/url.*", "go:bytes.*"],
    "javascript": ["js:*.concat", "js:*.replace", "js:*.trim", "js:*.toString", "js:*.slice", "js:String", "js:path.join", "js:JSON.stringify"],
    "java": ["*String.format", "*String.concat", "*StringBuilder.append", "*StringBuilder.toString", "*String.trim", "*String.replace*"],
    "ruby": ["ruby:*.to_s", "ruby:*.strip", "ruby:*.gsub", "ruby:*.join", "ruby:format"],
    "rust": [*(f"rust:{m}" for m in ("nth", "next", "into_iter", "deref", "as_ref", "into", "from", "clone", "index", "to_string")), "*::unwrap", "*::expect", "*::unwrap_or_default", "rust:alloc::fmt::format*", "rust:*format", "*::to_string", "*::to_owned", "*::as_str", "*::clone", "*::into"],
    "c": ["c:strcpy", "c:strcat", "c:sprintf", "c:snprintf", "c:strdup", "c:memcpy"],
}
ALWAYS = ["builtin.append", "builtin.format", "builtin.identity"]
SHORT = {"python": "py", "javascript": "js"}

#: class -> (severity, cwe, message, {language: (sinks, sanitizers, validators)}, guard)
CLASSES: dict[str, tuple[str, str, str, dict[str, tuple[list, list, list]], str | None]] = {
    "sql-injection": ("high", "CWE-89", "untrusted text in an SQL statement", {
        "python": (["*.execute#0", "*.executemany#0", "*.executescript#0", "py:sqlalchemy.text#0"], ["py:int", "py:float"], []),
        "go": (["*sql.DB*.Query#0", "*sql.DB*.QueryRow#0", "*sql.DB*.Exec#0", "*sql.Tx*.Exec#0", "*gorm.DB*.Raw#0", "*gorm.DB*.Where#0"], ["go:strconv.Atoi", "go:strconv.ParseInt"], []),
        "javascript": (["js:*.query#0", "js:sequelize.literal#0", "js:knex.raw#0"], ["js:Number", "js:parseInt", "js:mysql.escape"], []),
        "java": (["*Statement.execute*#0", "*Connection.prepareStatement#0", "*JdbcTemplate.query*#0", "*EntityManager.createNativeQuery#0"], ["*Integer.parseInt", "*Long.parseLong"], []),
        "ruby": (["ruby:*.where#0", "ruby:*.find_by_sql#0", "ruby:*.execute#0"], ["ruby:*.to_i", "ruby:*.sanitize_sql*"], []),
        "rust": (["rust:sqlx::query*#0", "*::execute#0"], ["*::parse*"], []),
        "c": (["c:sqlite3_exec#1", "c:mysql_query#1", "c:PQexec#1"], ["c:atoi", "c:strtol"], []),
    }, None),
    "command-injection": ("critical", "CWE-78", "untrusted text in a command", {
        "python": (["py:os.system#0", "py:os.popen#0", {"match": "py:subprocess.*", "when": 'kwargs.shell.String == "True" || arg[0].Type == "string"'}], ["py:shlex.quote", "py:pipes.quote"], []),
        "go": ([{"match": "go:os/exec.Command", "when": 'any(arg, {.String in ["sh", "bash", "/bin/sh", "-c"]}) || arg[0].Tainted'}, "go:syscall.Exec#0"], [], []),
        "javascript": (["js:child_process.exec#0", "js:child_process.execSync#0", "js:shelljs.exec#0"], ["js:shell-quote.quote"], []),
        "java": (["*Runtime.exec#0", "*ProcessBuilder.<init>#0"], [], []),
        "ruby": (["ruby:system#0", "ruby:exec#0", "ruby:Open3.*#0", "ruby:IO.popen#0"], ["ruby:Shellwords.escape", "ruby:Shellwords.shellescape"], []),
        "rust": (["rust:*Command::new#0", "rust:*Command::arg#1"], [], []),
        "c": (["c:system#0", "c:popen#0", "c:execl*#0", "c:execv*#0"], [], []),
    }, None),
    "path-traversal": ("high", "CWE-22", "untrusted path", {
        "python": (["py:open#0", "py:os.remove#0", "py:shutil.rmtree#0", "py:flask.send_file#0"], ["*.basename", "*.secure_filename"], ["*.is_safe_path", "*.is_relative_to"]),
        "go": (["go:os.Open#0", "go:os.ReadFile#0", "go:os.Create#0", "go:net/http.ServeFile#2"], ["go:path.Base", "go:path/filepath.Base"], ["go:strings.HasPrefix", "go:path/filepath.IsLocal"]),
        "javascript": (["js:fs.readFile*#0", "js:fs.writeFile*#0", "js:fs.createReadStream#0", "js:res.sendFile#0"], ["js:path.basename"], ["js:*.startsWith"]),
        "java": (["*FileInputStream.<init>#0", "*java.io.File.<init>#0", "*Paths.get#0"], ["*FilenameUtils.getName"], ["*.startsWith"]),
        "ruby": (["ruby:File.open#0", "ruby:File.read#0", "ruby:send_file#0"], ["ruby:File.basename"], ["ruby:*.start_with?"]),
        "rust": (["rust:std::fs::read*#0", "rust:std::fs::File::open#0", "rust:std::fs::write#0"], ["*::file_name"], ["*::starts_with"]),
        "c": (["c:fopen#0", "c:open#0", "c:unlink#0"], ["c:basename"], ["c:strncmp"]),
    }, None),
    "ssrf": ("high", "CWE-918", "request to an address that can be chosen", {
        "python": (["py:requests.*#0", "py:urllib.request.urlopen#0", "py:httpx.*#0"], [], []),
        "go": (["go:net/http.Get#0", "go:net/http.Post#0", "go:net/http.NewRequest#1"], [], []),
        "javascript": (["js:axios*#0", "js:fetch#0", "js:http.get#0", "js:https.get#0"], [], []),
        "java": (["*java.net.URL.<init>#0", "*RestTemplate.getForObject#0", "*HttpRequest.newBuilder#0"], [], []),
        "ruby": (["ruby:Net::HTTP.get*#0", "ruby:URI.open#0", "ruby:HTTParty.*#0"], [], []),
        "rust": (["rust:reqwest::get#0", "rust:reqwest::Client::get#0"], [], []),
    }, "not hostFixed()"),
    "open-redirect": ("medium", "CWE-601", "redirect to an address that can be chosen", {
        "python": (["py:flask.redirect#0", "py:django.shortcuts.redirect#0"], ["py:flask.url_for"], ["*.url_has_allowed_host_and_scheme", "*.is_safe_url"]),
        "go": (["go:net/http.Redirect#2", "*gin.Context*.Redirect#1"], [], []),
        "javascript": (["js:res.redirect#0", "js:ctx.redirect#0"], [], ["js:*.startsWith"]),
        "java": (["*HttpServletResponse.sendRedirect#0"], [], []),
        "ruby": (["ruby:redirect_to#0"], ["ruby:url_for"], []),
        "rust": (["rust:axum::response::Redirect::to#0"], [], []),
    }, "not hostFixed()"),
    "xss": ("medium", "CWE-79", "untrusted text in a page", {
        "python": (["py:markupsafe.Markup#0", "py:flask.render_template_string#0"], ["py:html.escape", "py:markupsafe.escape", "py:bleach.clean"], []),
        "go": (["go:fmt.Fprintf", "*http.ResponseWriter*.Write#0", "go:html/template.HTML#0"], ["go:html.EscapeString", "go:html/template.HTMLEscapeString"], []),
        "javascript": (["js:res.send#0", "js:document.write#0", "js:*.innerHTML", "js:*dangerouslySetInnerHTML", "js:__*_html#0", "js:__*_url#0"], ["js:DOMPurify.sanitize", "js:encodeURIComponent", "js:escapeHtml"], []),
        "java": (["*PrintWriter.print*#0", "*PrintWriter.write#0"], ["*StringEscapeUtils.escapeHtml*", "*Encode.forHtml*", "*HtmlUtils.htmlEscape"], []),
        "ruby": (["ruby:raw#0", "ruby:*.html_safe"], ["ruby:sanitize", "ruby:h", "ruby:ERB::Util.html_escape"], []),
        "rust": (["rust:axum::response::Html#0"], ["*::encode_text", "*::escape*"], []),
    }, None),
    "deserialization": ("high", "CWE-502", "untrusted data is turned into objects", {
        "python": (["py:pickle.load*#0", "py:yaml.load#0", "py:yaml.unsafe_load#0", "py:marshal.loads#0", "py:dill.loads#0"], [], []),
        "javascript": (["js:node-serialize.unserialize#0", "js:js-yaml.load#0"], [], []),
        "java": (["*ObjectInputStream.<init>#0", "*XMLDecoder.<init>#0", "*Yaml.load#0"], [], []),
        "ruby": (["ruby:Marshal.load#0", "ruby:YAML.unsafe_load#0"], [], []),
    }, None),
    "code-injection": ("critical", "CWE-94", "untrusted text is run as code", {
        "python": (["py:eval#0", "py:exec#0", "py:compile#0"], ["py:ast.literal_eval"], []),
        "javascript": (["js:eval#0", "js:Function#0", "js:vm.runIn*#0"], [], []),
        "ruby": (["ruby:eval#0", "ruby:*.instance_eval#0", "ruby:*.send#0"], [], []),
    }, None),
    "template-injection": ("high", "CWE-1336", "untrusted text is a template", {"python": (["py:jinja2.Template#0", "*.from_string#0"], [], [])}, None),
    "ldap-injection": ("high", "CWE-90", "untrusted text in an LDAP filter", {"python": (["*.search_s#2", "*.search_ext*#2"], ["*.escape_filter_chars"], [])}, None),
    "xpath-injection": ("medium", "CWE-643", "untrusted text in an XPath expression", {"python": (["*.xpath#0", "*.findall#0"], [], [])}, None),
    "zip-slip": ("high", "CWE-22", "archive members are written where their names say", {"python": (["py:tarfile.*.extractall", "py:zipfile.*.extractall"], [], [])}, None),
    "format-string": ("high", "CWE-134", "untrusted format", {"c": (["c:printf#0", "c:fprintf#1", "c:syslog#1"], [], [])}, None),
    "buffer-overflow": ("high", "CWE-120", "copy without a bound", {"c": (["c:strcpy#1", "c:strcat#1", "c:sprintf"], ["c:strnlen"], [])}, None),
}

#: Calls that are banned whatever reaches them: (id, language, severity, cwe, callees, guard, constant argument)
BANNED = [
    ("py-insecure-tls", "python", "medium", "CWE-295", ["py:requests.*", "py:httpx.*"], 'kwargs.verify.String == "False"', None),
    ("py-debug-server", "python", "medium", "CWE-489", ["*.run"], 'kwargs.debug.String == "True"', None),
    ("py-shell-true", "python", "low", "CWE-78", ["py:subprocess.*"], 'kwargs.shell.String == "True" and not arg[0].Complete', None),
    ("py-weak-hash", "python", "medium", "CWE-327", ["py:hashlib.md5", "py:hashlib.sha1"], None, None),
    ("py-weak-hash-name", "python", "medium", "CWE-327", ["py:hashlib.new"], None, {"index": 0, "matches": "(?i)^(md5|sha1)$"}),
    ("py-temp-name", "python", "low", "CWE-377", ["py:tempfile.mktemp"], None, None),
    ("go-weak-hash", "go", "medium", "CWE-327", ["go:crypto/md5.*", "go:crypto/sha1.*"], None, None),
    ("go-weak-cipher", "go", "high", "CWE-327", ["go:crypto/des.*", "go:crypto/rc4.*"], None, None),
    ("go-weak-random", "go", "low", "CWE-338", ["go:math/rand.*"], None, None),
    ("java-weak-hash", "java", "medium", "CWE-327", ["*MessageDigest.getInstance"], None, {"index": 0, "matches": "(?i)^(md5|sha-?1)$"}),
    ("java-weak-cipher", "java", "high", "CWE-327", ["*Cipher.getInstance"], None, {"index": 0, "matches": "(?i)^(des|rc4|.*/ecb/)"}),
    ("java-weak-random", "java", "low", "CWE-338", ["*java.util.Random.<init>"], None, None),
    ("c-unbounded-read", "c", "high", "CWE-242", ["c:gets", "cpp:gets"], None, None),
    ("js-weak-hash", "javascript", "medium", "CWE-327", ["js:crypto.createHash"], None, {"index": 0, "matches": "(?i)^(md5|sha1)$"}),
]


def rules() -> list[dict]:
    out = []
    for name, (severity, cwe, message, langs, when) in CLASSES.items():
        for lang, (sinks, sanitizers, validators) in langs.items():
            r = {"id": f"{SHORT.get(lang, lang)}-{name}", "severity": severity, "cwe": cwe, "message": message, "languages": [lang] if lang != "c" else ["c", "cpp"], "sources": SOURCES[lang], "sinks": sinks, "sanitizers": sanitizers, "validators": validators, "propagators": PASSING[lang]}
            out.append(r | ({"when": when} if when else {}))
    for name, lang, severity, cwe, callees, when, const in BANNED:
        r = {"id": name, "kind": "dangerous-call", "severity": severity, "cwe": cwe, "languages": [lang], "callees": callees}
        out.append(r | ({"when": when} if when else {}) | ({"const_arg": const} if const else {}))
    return out
