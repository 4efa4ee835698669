import random

from glossa.plans import cli


def test_tagging_commands(spark, tmp_path):
    (tmp_path / "train.txt").write_text("-DOCSTART- -X- O O\n\n" + "Peter NNP I-NP B-PER\nlives VBZ I-VP O\nin IN I-PP O\nWien NNP I-NP B-LOC\n\n" * 4)
    train, model, out = (str(tmp_path / n) for n in ("train.txt", "model", "out"))
    cli.main(["ner-train", train, model, "-f", "zj03", "-E", "3", "--learner", "perceptron"], spark)
    cli.main(["ner-predict", model, train, out], spark)
    lines = [r.value for r in spark.read.text(out).collect() if r.value]
    assert len(lines) == 16 and all(x.split()[-1] == x.split()[-2] for x in lines)


def test_cross_language_command(spark, tmp_path, capsys):
    rnd = random.Random(0)

    def corpus(name, good, bad, n, lang):
        lines = []
        for i in range(n):
            words = rnd.sample(good if i % 2 else bad, 2) + rnd.sample([f"{lang}{k}" for k in range(12)], 4)
            lines.append(" ".join(f"{w}:1" for w in words) + f" #label#:{'positive' if i % 2 else 'negative'}")
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    en, de = (["good", "fine", "great"], ["bad", "poor", "awful"]), (["gut", "fein", "toll"], ["schlecht", "mies", "arg"])
    files = [corpus("s", *en, 60, "e"), corpus("su", *en, 80, "e"), corpus("tu", *de, 80, "d"), corpus("t", *de, 40, "d")]
    (tmp_path / "dict").write_text("".join(f"{a}\t{b}\n" for a, b in zip(en[0] + en[1], de[0] + de[1], strict=True)))
    cli.main(["cross-language", *files, str(tmp_path / "dict"), "--phi", "2", "-m", "6", "-k", "3", "--visits", "4000", "--repetitions", "2"], spark)
    assert float(capsys.readouterr().out.split("ACC: ")[1].split()[0]) > 80
