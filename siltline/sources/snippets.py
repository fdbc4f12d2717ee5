"""Small source texts in every language, from which the tables' source trees are made (see adapters)."""

from __future__ import annotations

SNIPPETS: list[tuple[str, str]] = [
    ("ts", "import { log } from './log';\n\n// loads all pages\nexport async function loadAll(urls: string[]) {\n  const seen = new Set();\n  for (const u of urls) {\n    if (seen.has(u) || !u) {\n      continue;\n    } else if (u.length > 99 && !force || dry) {\n      console.warn('long', u);\n    }\n    try {\n      const body = await get(u) ?? null;\n      console.log(body ? 'ok' : 'none');\n    } catch (e) {\n      logger.error(e);\n    }\n  }\n}\nconst twice = (x) => { return x * 2; };\n"),
    ("js", "/* header\n   of the file\n*/\nclass Cart {\n  add(item) {\n    while (item.next) {\n      item = item.next;\n    }\n    // console.log(item);\n    /* toastr.info(item) */\n    toastr.success('added');\n  }\n}\n$log.debug('x'); console.error('y');\n"),
    ("cs", "using System;\n\nnamespace Shop\n{\n    /// orders\n    public class Orders\n    {\n        public int Count(string name)\n        {\n            if (name == null && strict)\n            {\n                _logger.LogWarning(\"none\");\n                return 0;\n            }\n            foreach (var x in All())\n            {\n                switch (x.Kind)\n                {\n                    case 1: Hit(x); break;\n                    case 2: Miss(x); break;\n                }\n            }\n            try { Save(); }\n            catch (IOException e) when (e.HResult > 0) { Log.Error(e, \"io\"); }\n            finally { Close(); }\n            return a ?? b;\n        }\n        void Declared(int x);\n    }\n}\n"),
    ("java", "package shop;\n\n/**\n * Stock.\n */\npublic class Stock {\n  private int left = 3;\n\n  public int take(int n) {\n    if (n > left || n < 0) {\n      log.warn(\"too many\");\n      return 0;\n    } else {\n      left -= n;\n    }\n    for (int k = 0; k < n; k++) {\n      if (k % 2 == 0) { System.out.println(k); }\n    }\n    String s = n > 1 ? \"{\" : \"one\";\n    logger.info(s); // done {\n    return n;\n  }\n}\n"),
    ("c", "#include <stdio.h>\n/* entry */\nint main(int argc, char *argv) {\n  int i;\n  for (i = 0; i < argc; i++) {\n    if (i == 3) goto end;\n    printf(\"%d\", i);\n  }\n  fprintf(stderr, \"x\"); /* mid\n  perror(\"hidden\");\n  */\nend:\n  puts(\"bye\");\n  return 0;\n}\n"),
    ("cpp", "#include <iostream>\nstruct Node { int v; };\nint depth(Node *n) {\n  if (!n) { return 0; }\n  std::cout << n->v;\n  while (n && n->v > 0 || n->v < -9) {\n    n->v--;\n  }\n  LOG(INFO) << 1;\n  spdlog::error(\"e\");\n  return 1;\n}\n"),
    ("go", "package main\n\nfunc run(jobs chan int) {\n\tfor {\n\t\tselect {\n\t\tcase j := <-jobs:\n\t\t\tif (j > 3) {\n\t\t\t\tlog.Printf(\"job\")\n\t\t\t}\n\t\t}\n\t}\n}\n\nfunc (s *Server) Stop() {\n\tzl.Info(\"stop\")\n\tfmt.Println(\"x\")\n}\n"),
    ("rs", "pub fn area(s: &Shape) -> f64 {\n    match s {\n        Shape::Dot => 0.0,\n        Shape::Box(w) => {\n            if let Some(x) = w { info!(\"w\"); }\n            loop { break; }\n            1.0\n        }\n    }\n}\n// println!(\"old\");\nfn main() { println!(\"{}\", 1); eprintln!(\"e\"); }\n"),
    ("kt", "class Store {\n    override fun load(id: Int): Item? {\n        when (id) {\n            0 -> return null\n            else -> Timber.d(\"load\")\n        }\n        println(id)\n        return cache[id]\n    }\n}\n"),
    ("php", "<?php\n# settings\nfunction send($to, $text) {\n    foreach ($to as $t) {\n        if ($t == '') { continue; }\n        elseif ($t == 'x') { error_log('x'); }\n        echo $t;\n    }\n    $this->logger->notice($text);\n    Log::error('gone');\n}\n"),
    ("swift", "func greet(name: String?) {\n    guard let n = name else { return }\n    repeat {\n        print(n)\n    } while (again && true)\n    NSLog(\"done\")\n    logger.fault(\"f\")\n}\n"),
    ("rb", "# orders\nclass Order\n  def total(items)\n    sum = 0\n    items.each do |i|\n      if i.price > 0 and i.ok || i.free\n        sum += i.price\n      elsif i.gift\n        puts 'gift'\n      else\n        warn 'odd'\n      end\n    end\n    sum unless sum < 0\n  end\nend\n=begin\nputs 'not code'\n=end\nlogger.info 'x'\n"),
    ("r", "# mean\navg <- function(x) {\n  if (length(x) == 0 || any(is.na(x))) {\n    warning(\"empty\")\n  } else if (sum(x) > 9) {\n    print(x)\n  } else {\n    for (i in x) { cat(i) }\n  }\n}\n"),
    ("dart", "void main() {\n  if (ready && open) {\n    print('go');\n  }\n  var x = a ?? b;\n  log('text');\n  logger.w('warn');\n}\n"),
    ("scala", "object Main {\n  def run(n: Int): Int = {\n    n match {\n      case 0 => println(\"zero\")\n      case _ => logger.info(\"n\")\n    }\n    if (n > 1) run(n - 1) else 0\n  }\n}\n"),
    ("py", "\"\"\"Module text.\n\nif this and that\n\"\"\"\nimport logging\n\n\nclass Job:\n    '''one line'''\n\n    def run(self, rows):\n        # print(rows)\n        for r in rows:\n            if r and r.ok or r.forced:\n                logging.info('row')\n            elif r is None:\n                print('none')\n            else:\n                x = 1 if r else 2\n        try:\n            pass\n        except ValueError:\n            logger.exception('v')\n\n    async def stop(self):\n        while self.on:\n            break\n"),
    ("html", "<!DOCTYPE html>\n<html>\n<!-- head\n  follows -->\n<body class=\"x\">\n  <div><img src=\"a.png\"><br/>\n    <p>text</p> <!-- note -->\n  </div>\n  <script>\n    if (a && b) {\n      run();\n    }\n  </script>\n  <script>inline();</script>\n</body>\n</html>\n"),
    ("md", "# Notes\nif (x) { y }\n"),
    ("js", ""),
]
