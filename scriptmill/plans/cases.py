"""Scripts of our own and what becomes of them: (rule that each is for, preset, source, result). Fixed values."""

CASES = [
    (
        "VariableDeclarationSplit",
        "generic",
        "var left = width(), right = height(); draw(left, right);",
        "var left = width();\nvar right = height();\ndraw(left, right);",
    ),
    (
        "VarHoisting",
        "generic",
        "start(); var later; stop(later);",
        "var later;\nstart();\nstop(later);",
    ),
    (
        "GlobalAliasSimplification",
        "generic",
        "var root = window; log(root.Math.floor(9.75));",
        "log(9);",
    ),
    (
        "DeclarationMerge",
        "generic",
        "var total; begin(); total = 40; report(total);",
        "begin();\nreport(40);",
    ),
    (
        "ConstantInlining",
        "generic",
        "var limit = 12; check(limit, limit + 1);",
        "check(12, 13);",
    ),
    (
        "ConstantInlining",
        "generic",
        "for (var size = 6, at = 0; at < size; at++) {} tell(size);",
        "for (var at = 0; at < 6; at++) {}\ntell(6);",
    ),
    (
        "ProxyFunctionInlining",
        "generic",
        "function sub(u, w) { return u - w; } out(sub(sub(50, 8), 2));",
        "out(40);",
    ),
    (
        "ProxyFunctionInlining",
        "generic",
        'function call(fn, z) { return fn(z); } call(notify, "hey");',
        'notify("hey");',
    ),
    (
        "BlockNormalization",
        "generic",
        "if (ready) go(); while (more()) next();",
        "if (ready) {\n    go();\n}\nwhile (more()) {\n    next();\n}",
    ),
    (
        "BitwiseSimplification",
        "generic",
        "var mix = (m | n) & ~(m & n); use(mix);",
        "var mix = m ^ n;\nuse(mix);",
    ),
    (
        "BitwiseSimplification",
        "generic",
        "var mask = ~(~m & ~n); use(mask, m + n - 2 * (m & n));",
        "var mask = m | n;\nuse(mask, m ^ n);",
    ),
    (
        "ConstantFolding",
        "generic",
        "put(6 * 7 - 2 ** 3, 17 % 5, !0, typeof 'q', void 0);",
        'put(34, 2, true, "string", undefined);',
    ),
    (
        "StringConcatenation",
        "generic",
        'var pre = "re"; say(pre + "act" + "or");',
        'say("reactor");',
    ),
    (
        "BuiltinEvaluation",
        "generic",
        'say(parseInt("1011", 2), String.fromCharCode(74, 83), Math.max(3, 9, 4));',
        'say(11, "JS", 9);',
    ),
    (
        "LiteralMethodEvaluation",
        "generic",
        'say("sandbox".slice(0, 4), "a-b".replace("-", "+"), ["p", "q"].length);',
        'say("sand", "a+b", 2);',
    ),
    (
        "Comma",
        "generic",
        "var last = (0, 5 * 5); use(last, 1);",
        "var last = 25;\nuse(last, 1);",
    ),
    (
        "Member",
        "generic",
        'node["child"]["if"]["not-a-name"] = data["x1"];',
        'node.child.if["not-a-name"] = data.x1;',
    ),
    (
        "ControlFlow",
        "generic",
        "if (!0) { yes(); } else { no(); } if (w) {} else { other(); }",
        "yes();\nif (!w) {\n    other();\n}",
    ),
    (
        "FunctionDeclaration",
        "generic",
        "var act = function(a) { return a + g; }; act(1); act(2);",
        "function act(a) {\n    return a + g;\n}\nact(1);\nact(2);",
    ),
    (
        "TernaryToIf",
        "generic",
        "ok ? left() : right();",
        "if (ok) {\n    left();\n} else {\n    right();\n}",
    ),
    (
        "LogicalToIf",
        "generic",
        "ok && left(); ok || right();",
        "if (ok) {\n    left();\n}\nif (!ok) {\n    right();\n}",
    ),
    (
        "SequenceStatement",
        "generic",
        "one(), two(), three(); switch ((prep(), kind)) { case 2: go(); break; }",
        "one();\ntwo();\nthree();\nprep();\nswitch (kind) {\n    case 2:\n        go();\n        break;\n}",
    ),
    (
        "DeadCode",
        "generic",
        "function z() { return 5; never(); } keep(z);",
        "function z() {\n    return 5;\n}\nkeep(z);",
    ),
    (
        "UnusedVariable",
        "generic",
        "var gone = 3; let also = 4; stay();",
        "stay();",
    ),
    (
        "VariableRenaming",
        "generic",
        "var _0x12ab = make(); take(_0x12ab);",
        "var _0x12ab = make();\ntake(_0x12ab);",
    ),
    (
        "none",
        "generic",
        "with (a) {}",
        "with (a) {}",
    ),
    (
        "ConstantFolding",
        "jsfuck",
        "say((![] + [])[+[]], +!![] + !![]);",
        "say((false + [])[0], 2);",
    ),
    (
        "SetTimeoutUnwrap",
        "datadome",
        "setTimeout(function() { mark = 77; }, 0); done(mark);",
        "mark = 77;\ndone(mark);",
    ),
    (
        "InitializerInlining",
        "akamai",
        "var box; function fill() { box = [7, 8]; } fill(); use(box); skip && use(box[1]);",
        "var box;\nfunction fill() {}\nbox = [7, 8];\nuse(box);\nif (skip) {\n    use(box[1]);\n}",
    ),
    (
        "SwitchDispatch",
        "akamai",
        "function steps(at, arg) { while (at != 40) { switch (at) { case 10: open(Mh); at += 20; break; case 30: close(); at = 40; break; } } } steps(10, z);",
        "function steps(at, arg) {\n    while (at != 40) {\n        switch (at) {\n            case 10:\n                at = 30;\n                break;\n            case 30:\n                at = 40;\n                break;\n        }\n    }\n}\nfunction steps_10(Mh) {\n    open(Mh);\n    close();\n}\nsteps_10(z);",
    ),
    (
        "StringArrayDecoder",
        "obfuscator-io",
        'var codes = ["cmVk", "Z3JlZW4=", "Ymx1ZQ==", "cGluaw=="]; function read(i, j) { return j = codes[i], atob(j) } paint(read(1), read(3));',
        'paint("green", "pink");',
    ),
    (
        "StringArrayDecoder",
        "obfuscator-io",
        'var codes = ["cmVk", "Z3JlZW4=", "Ymx1ZQ=="]; async function read(i) { return atob(codes[i]) } paint(read(1));',
        """var codes = ["cmVk", "Z3JlZW4=", "Ymx1ZQ=="];
async function read(i) {
    return atob(codes[i]);
}
paint(read(1));""",
    ),
    (
        "ControlFlowFlattening",
        "obfuscator-io",
        "for (var st = 3; true;) { switch (st) { case 3: alpha(); st = 8; continue; case 8: beta(); st = 5; continue; case 5: gamma(); break; } break; }",
        "alpha();\nbeta();\ngamma();",
    ),
    (
        "ControlFlowFlattening",
        "obfuscator-io",
        "for (var st = 3; true;) { switch (st) { case 3: alpha(); st = 8; continue; case 8: beta(); } break; }",
        "alpha();\nbeta();",
    ),
    (
        "ControlFlowFlattening",
        "obfuscator-io",
        "for (var st = 3; true;) { switch (st) { case 3: alpha(); st = 8; continue; case 8: } break; }",
        "alpha();",
    ),
    (
        "ControlFlowFlattening",
        "obfuscator-io",
        "for (var st = 1; true;) { switch (st) { case 1: alpha(); st = 2; continue; case 2: beta(); st = 1; continue; } break; }",
        "for (var st = 1; true;) {\n    switch (st) {\n        case 1:\n            alpha();\n            st = 2;\n            continue;\n        case 2:\n            beta();\n            st = 1;\n            continue;\n    }\n    break;\n}",
    ),
    (
        "ControlFlowArray",
        "obfuscator-io",
        """function mixer(p, q, r, u, m, x, y, z) { return (p * x ^ y * u ^ r * q) >>> 0 & m - 1; }
var grid;
!function(run, k) { var w; var cells = []; for (k = 0; k < 16; k++) { cells[k] = new Array(256); }
function fill(b) { for (var i = 32 * b, e = Math.min(i + 32, 256), c = i; c < e; c++) { for (w = 0; w < 16; w++) { cells[w][c] = cells[mixer(c, 57, 3, 211, 16, 77, w)]; } } }
for (var j = 0; j < 8; j++) { (function(b) { run(function() { fill(b); }); })(j); }
run(function() { grid = cells[5]; }); }(function(go) { setTimeout(go, 0); });
pick(grid[21][9], grid["4"][200]);""",
        "pick(1, 3);",
    ),
    (
        "StringArrayRotation",
        "obfuscator-io",
        """function shelf() { var row = ["okapi", "skink", "eland", "4otter", "finch", "9lynx", "heron", "stoat", "6ibis", "raven", "civet", "tapir"]; shelf = function() { return row; }; return shelf(); }
function pull(n) { n = n - 300; return shelf()[n]; }
(function(list, goal) { var g = pull; while (true) { try { var sum = parseInt(g(300)) / 1 + parseInt(g(302)) * 2 + -parseInt(g(305)) / 3; if (sum === goal) break; else list.push(list.shift()); } catch (e) { list.push(list.shift()); } } })(shelf, 20);
var p = pull; show(p(301), p("0x12f"), pull(304));""",
        """function shelf() {
    var row = ["okapi", "skink", "eland", "4otter", "finch", "9lynx", "heron", "stoat", "6ibis", "raven", "civet", "tapir"];
    shelf = function() {
        return row;
    };
    return shelf();
}
function pull(n) {
    n = n - 300;
    return shelf()[n];
}
(function(list, goal) {
    var g = pull;
    while (true) {
        try {
            if (20 === goal) {
                break;
            } else {
                list.push(list.shift());
            }
        } catch (e) {
            list.push(list.shift());
        }
    }
})(shelf, 20);
var p = pull;
show("finch", "heron", "stoat");""",
    ),
    (
        "StringArrayRC4Decoder",
        "obfuscator-io",
        """function shelf() { var row = ["m1VdGCkpW70", "dCk2eJZcVW", "s3BdQCkjqhW", "qSkKW5amWRa", "WOfSWPpcRGG", "B0neW4nk", "W7pdRXBdL8kb", "zmodW7RcUSoA", "dCkllGtdPW", "WRG4WQpcPSk3", "WQShrCk7WRe", "WQlcUIJdVSon"]; shelf = function() { return row; }; return shelf(); }
function pull(n, k) { n = n - 300; var list = shelf(), letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/="; return list[n]; }
(function(list, goal) { var g = pull; while (true) { try { var sum = parseInt(g(300, "q0")) + parseInt(g(302, "q2")) * 2 - parseInt(g(305, "q5")); if (sum === goal) break; else list.push(list.shift()); } catch (e) { list.push(list.shift()); } } })(shelf, 16);
show(pull(301, "q1"), pull(304, "q4"));""",
        'show("finch", "stoat");',
    ),
    (
        "BrowserifyAnnotation",
        "debundler",
        '!function(list, seen, entry) { boot(list); }({7: [function(need, out, all) { var kit = need("./parts/kit.js"); kit(); }, {"./parts/kit.js": 9}], 9: [function(need, out, all) { out.exports = 1; }, {}]}, {}, [7]);',
        """!function(list, seen, entry) {
    boot(list);
}({
    7: [function module_7(need, out, all) {
        /** @type {parts_kit} */ var kit = need("./parts/kit.js");
        kit();
    }, { "./parts/kit.js": 9 }],
    9: [function parts_kit(need, out, all) {
        out.exports = 1;
    }, {}]
}, {}, [7]);""",
    ),
]
