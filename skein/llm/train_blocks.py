"""Trains the block network: ``python -m skein.llm.train_blocks PAGES.parquet`` writes the weights beside this module.

The pages carry no labels, so they are labelled here by what each kind of boilerplate says (the fixed lists below), and
by where teasers stand: after their heading, until a blank line or another notice. The lists serve training only; the
network has to carry what they teach over to lines they do not name, and its held-out sites show how well it does.
"""

from __future__ import annotations

import re
import sys
import time

import numpy as np

from skein.llm.blocks import BITS, FIGURES, HIDDEN, TAG_WIDTH, TAGS, WEIGHTS, WIDTH, Network, Reader

MAX_PAGES = 30_000

# Entries of navigation menus.
MENU = set(
    "home|news|archive|search|contact|about us|log in|shop|gallery|glossary|podcast|events calendar|for teachers|data portal|missions|rings|moons|small bodies|privacy|imprint|terms of use|menu|sitemap|help|faq|careers|press|"
    "accueil|actualités|archives|recherche|à propos|connexion|galerie|lexique|agenda|anneaux|lunes|mentions légales|vie privée|boutique|"
    "startseite|aktuelles|archiv|suche|kontakt|über uns|anmelden|glossar|termine|missionen|ringe|monde|impressum|datenschutz|agb|menü|"
    "inicio|noticias|archivo|buscar|contacto|quiénes somos|acceder|galería|glosario|misiones|anillos|lunas|aviso legal|privacidad|menú|tienda".split("|")
)
# Headings under which teasers of other articles stand.
TEASERS = re.compile(
    r"^\W*(?:more from this section|related stories|read next|you may also like|also of interest|dans la même rubrique|à lire aussi|sur le même sujet|mehr zum thema|das könnte sie auch interessieren|weiterlesen|artículos relacionados|más de esta sección|siga leyendo|también le puede interesar|lea también)\W*$",
    re.I,
)
# What notices, prompts, bylines, dates, counters, tags, credits and legal lines say.
NOTICES = re.compile(
    r"^\W*(?:"
    r"we use cookies\b|by continuing to browse|some partners of|this site measures visits|.{3,40} keeps small files on|accept all|reject non-essential|manage preferences|ok, got it|skip to main content|"
    r"nous utilisons des cookies|en poursuivant sur|des partenaires de|.{3,40} dépose de petits fichiers|tout accepter|continuer sans accepter|paramétrer mes choix|accepter \| refuser|aller au contenu|"
    r"wir verwenden cookies|mit dem besuch von|partner von .{3,40} dürfen|.{3,40} legt kleine dateien|alle annehmen|nur notwendige|einstellungen ändern|annehmen \| ablehnen|zum inhalt springen|"
    r"usamos cookies|al seguir en|algunos socios de|.{3,40} guarda pequeños archivos|aceptar todo|solo las necesarias|configurar\W*$|aceptar \| rechazar|ir al contenido|"
    r"reproduction without written consent|images are the property of|figures on .{3,40} are given|registered as a charity|©|\(c\) |.{3,40} is not responsible for linked|"
    r"reproduction interdite|chiffres fournis par|.{3,40} décline toute|.{3,40} haftet nicht für|alle angaben auf|nachdruck nur|prohibida la reproducción|.{3,40} no responde de los|datos de .{3,40} sin garantía|"
    r"tell others what|never miss a flyby|share on|share this page|liked this\?|print \||support .{3,40} with a small|enter your e-mail|get the .{3,40} letter|join \d+ readers|follow us|back to top|loading comments|advertisement\W*$|"
    r"faites connaître|la lettre de|partager cette page|imprimer \||soutenez|saisissez votre adresse|haut de page|publicité\W*$|suivez-nous|rejoignez|chargement des|"
    r"der brief von|diese seite teilen|drucken \||unterstützen sie|bitte e-mail-adresse|nach oben\W*$|anzeige\W*$|gefällt ihnen der beitrag|folgen sie|kommentare werden|"
    r"el boletín de|compartir esta página|imprimir \||apoye a|escriba su correo|volver arriba|publicidad\W*$|recomiende|síganos|cargando|"
    r"posted on \d|last changed|publié le \d|lecture \d|stand: \d|lesezeit|publicado el \d|lectura de \d|[\d.,]+ (?:views|comments|readers are|vues|commentaires|lecteurs|aufrufe|kommentare|leser|visitas|comentarios|lectores)\b|"
    r"tags:|mots-clés|schlagwörter|etiquetas:|schlagworte|"
    r"by [A-Z]\w+ [A-Z]\w+, staff|written by [A-Z]|text and charts:|par \w+ \w+, rédaction|texte : \w+ \w+$|von \w+ \w+, redaktion|text: \w+ \w+$|por \w+ \w+, redacción|texto: \w+ \w+$|\w+ \w+ \| (?:science desk|service sciences|ressort wissen|sección de ciencia)|"
    r"text supplied by|texte fourni par|text: agentur|texto de la agencia|"
    r"(?:next|previous|suivant|précédent|weiter|zurück|siguiente|anterior) ?: |« |home > |accueil > |startseite > |inicio > |you are here:|vous êtes ici|sie sind hier|está en:"
    r")",
    re.I,
)
_split = re.compile(r"\s*[|·]\s*")
_named = re.compile(r"\[([^\]]*)\]\([^)]*\)")


def _menu(line: str) -> bool:
    bare = _named.sub(r"\1", line).strip(" \t*-•#[]").lower()
    return all(part in MENU for part in _split.split(bare)) if bare else False


def weak_labels(chunk: str) -> dict[int, bool]:
    """line number -> outside the main body, for the non-blank lines."""
    out: dict[int, bool] = {}
    teasing = False
    for i, raw in enumerate(chunk.split("\n")):
        line = re.sub(r"\s+", " ", raw).strip()
        if not line:
            teasing = False
            continue
        notice = bool(NOTICES.match(line)) or _menu(line) or bool(re.match(r"^.{3,50} »$", line))
        if TEASERS.match(line):
            teasing, outside = True, True
        elif notice:
            teasing, outside = False, True
        else:
            outside = teasing
        out[i] = outside
    return out


def examples(chunks: list[str], urls: list[str | None]) -> list[tuple]:
    reader, found = Reader(), []
    for chunk, url in zip(chunks, urls):
        if chunk and not chunk.isspace():
            places, tags, words, figures = reader.page(chunk, url)
            marks = weak_labels(chunk)
            found.append((tags, words, figures, np.array([marks[p] for p in places], np.float32)))
    return found


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = WIDTH + TAG_WIDTH + FIGURES
    w = {"words": rng.normal(0, 0.1, (1 << BITS, WIDTH)), "tags": rng.normal(0, 0.1, (TAGS + 9, TAG_WIDTH)), "out": np.zeros(2 * HIDDEN + size), "bias": np.zeros(())}
    for name in "fr":
        w[f"w{name}"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN))
        w[f"u{name}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[f"b{name}"] = np.zeros(4 * HIDDEN)
        w[f"b{name}"][HIDDEN : 2 * HIDDEN] = 1
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w, x, mask, name, back):
    """Forward pass of one direction that keeps what the backward pass needs."""
    steps, pages, _ = x.shape
    gates = x @ w[f"w{name}"] + w[f"b{name}"]
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros((pages, HIDDEN), np.float32)
    kept, out = [None] * steps, np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        z = gates[t] + h @ w[f"u{name}"]
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before_h, before_c = h, c
        c = (s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g) * mask[t]
        tc = np.tanh(c)
        h = s[:, 2 * HIDDEN :] * tc
        kept[t] = (s, g, before_h, before_c, tc)
        out[t] = h
    return out, kept


def _back(w, x, mask, name, back, kept, above, grads):
    """Backward pass of one direction; returns the gradient of its input."""
    steps, pages, _ = x.shape
    dz = np.empty((steps, pages, 4 * HIDDEN), np.float32)
    dh = np.zeros((pages, HIDDEN), np.float32)
    dc = np.zeros((pages, HIDDEN), np.float32)
    du = np.zeros_like(w[f"u{name}"])
    for t in range(steps) if back else range(steps - 1, -1, -1):
        s, g, before_h, before_c, tc = kept[t]
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        dh = dh + above[t]
        dc = (dc + dh * o * (1 - tc * tc)) * mask[t]
        dz[t, :, :HIDDEN] = dc * g * i * (1 - i)
        dz[t, :, HIDDEN : 2 * HIDDEN] = dc * before_c * f * (1 - f)
        dz[t, :, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        dz[t, :, 3 * HIDDEN :] = dc * i * (1 - g * g)
        du += before_h.T @ dz[t]
        dh = dz[t] @ w[f"u{name}"].T
        dc = dc * f
    grads[f"u{name}"] = du
    grads[f"w{name}"] = x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * HIDDEN)
    grads[f"b{name}"] = dz.sum((0, 1))
    return dz @ w[f"w{name}"].T


def train(found: list[tuple], epochs: int = 6, batch: int = 48, rate: float = 4e-3, seed: int = 3, drop: float = 0.15, say=print) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = fresh(rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    order = sorted(range(len(found)), key=lambda i: len(found[i][0]))
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    step = 0
    for epoch in range(epochs):
        began, loss_sum, blocks = time.time(), 0.0, 0
        for gi in rng.permutation(len(groups)):
            group = [found[i] for i in groups[gi]]
            sizes = np.array([len(p[0]) for p in group])
            bags = [b for p in group for b in p[1]]
            # Words dropped at random make the network lean on tag paths and neighbours as well.
            bags = [[k for k in b if rng.random() > drop] or [0] for b in bags] if drop else bags
            starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
            words = np.fromiter((k for b in bags for k in b), np.int64)
            tags = np.array([t for p in group for t in p[0]])
            y = np.concatenate([p[3] for p in group])
            net = Network(w)
            flat = net.inputs(tags, words, starts, np.concatenate([p[2] for p in group]))
            steps = int(sizes.max())
            page = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x = np.zeros((steps, len(sizes), flat.shape[1]), np.float32)
            x[at, page] = flat
            mask = (np.arange(steps)[:, None] < sizes[None, :]).astype(np.float32)[:, :, None]
            ahead, kept_f = _run(w, x, mask, "f", False)
            behind, kept_r = _run(w, x, mask, "r", True)
            joint = np.concatenate([ahead[at, page], behind[at, page], flat], axis=1)
            p = 1 / (1 + np.exp(-np.clip(joint @ w["out"] + w["bias"], -30, 30)))
            loss_sum += float(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).sum())
            blocks += len(y)
            d = ((p - y) / len(y)).astype(np.float32)
            grads = {"out": joint.T @ d, "bias": d.sum()}
            dj = d[:, None] * w["out"]
            up_f, up_r = np.zeros_like(ahead), np.zeros_like(behind)
            up_f[at, page], up_r[at, page] = dj[:, :HIDDEN], dj[:, HIDDEN : 2 * HIDDEN]
            dx = (_back(w, x, mask, "f", False, kept_f, up_f, grads) + _back(w, x, mask, "r", True, kept_r, up_r, grads))[at, page] + dj[:, 2 * HIDDEN :]
            counts = np.diff(np.append(starts, len(words)))
            grads["words"] = np.zeros_like(w["words"])
            np.add.at(grads["words"], words, np.repeat(dx[:, :WIDTH] / np.sqrt(counts)[:, None], counts, axis=0))
            grads["tags"] = np.zeros_like(w["tags"])
            np.add.at(grads["tags"], tags, dx[:, WIDTH : WIDTH + TAG_WIDTH])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            step += 1
            now = rate * (1 - 0.9 * step / (epochs * len(groups)))
            for k, g in grads.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                w[k] = (w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        say(f"epoch {epoch}: loss {loss_sum / blocks:.4f} a block, {time.time() - began:.0f} s")
    return w


def evaluate(w: dict[str, np.ndarray], chunks: list[str], urls: list[str | None]) -> tuple[int, int, int]:
    """Blocks that are rightly outside, wrongly outside and wrongly inside, by the weak labels."""
    net, reader, right, over, under = Network(w), Reader(), 0, 0, 0
    for i, places, margins in net.label(reader, chunks, urls):
        marks = weak_labels(chunks[i])
        for p, m in zip(places, margins):
            right += bool(m > 0 and marks[p])
            over += bool(m > 0 and not marks[p])
            under += bool(m <= 0 and marks[p])
    return right, over, under


def main(path: str) -> None:
    import zlib

    import pyarrow.parquet as pq

    rows = pq.read_table(path, columns=["page_id", "chunk", "url"]).to_pylist()
    # A sample over all rows, by the hash of their ids.
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r["page_id"]).encode()))[:MAX_PAGES]
    chunks, urls = [r["chunk"] for r in rows], [r["url"] for r in rows]
    site = [re.sub(r"^(?:\w+://)?(?:www\.)?([^/:?#]*).*", r"\1", (u or "").lower()) for u in urls]
    held = [zlib.crc32(s.encode()) % 10 == 0 for s in site]
    w = train(examples([c for c, h in zip(chunks, held) if not h], [u for u, h in zip(urls, held) if not h]))
    right, over, under = evaluate(w, [c for c, h in zip(chunks, held) if h], [u for u, h in zip(urls, held) if h])
    print(f"sites held out: precision {right / max(1, right + over):.4f}, recall {right / max(1, right + under):.4f} of {right + under} blocks outside")
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in w.items()})


if __name__ == "__main__":
    main(sys.argv[1])
