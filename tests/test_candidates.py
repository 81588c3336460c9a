from evidra.operators import candidates as C
from evidra.operators import registry as R

PAGE = """# Ice Lake

Intro to the icelake-long partition. Use `module load gcc/11.3.0` first.

## Jobs

    #SBATCH -p icelake
    some text

```
sbatch --partition=icelake-himem run.sh
module load rhel8/icelake/base; module load "gromacs" lammps, -q <name> the
module load python-3.9 && module load default-impi # cuda
```

- not a command: module load foo/1.2
$ module load cuda/12.1

## Old

srun -p queue x
The wbic nodes were retired. `srun -p wbic x`
"""


def test_snippets():
    text = "Use `module load a/1` first.\n\n    #SBATCH -p icelake\n    some text\n\n$ module load cuda\nprose: module load b\n\tno code\nsrun x\n```\nanything\n```\n"
    assert C.snippets_of(text) == ["#SBATCH -p icelake\nsome text", "$ module load cuda", "srun x", "anything", "module load a/1", "\nanything\n"]
    assert C.snippets_of(None) == C.snippets_of("") == [] and C.snippets_of("    plain indent\n\tmodule x") == ["plain indent\nmodule x"] and C.snippets_of("```\nopen fence") == []


def test_candidates(spark):
    pages = spark.createDataFrame([("u1", PAGE, "Ice Lake"), ("u2", "no commands", "T"), ("u3", None, None)], "url string, text string, title string")
    rows = C.registry_candidates(pages, "url", "text", "title").collect()
    got = {(r.entity_type, r.canonical_name): r for r in rows}
    assert {n for k, n in got if k == "partition"} == {"icelake-long", "icelake", "icelake-himem", "wbic"}
    assert {n for k, n in got if k == "module"} == {"gcc/11.3.0", "rhel8/icelake/base", "gromacs", "lammps", "python-3.9", "default-impi", "cuda/12.1"}
    assert {n for k, n in got if k == "toolchain"} == {"rhel8/icelake/base", "default-impi", "cuda/12.1"}
    assert got["partition", "wbic"].status == "legacy" and got["partition", "icelake"].status == "current" and got["module", "default-impi"].status == "legacy" and got["module", "gromacs"].status == "unknown"
    assert got["module", "gcc/11.3.0"].known_versions == ["11.3.0"] and got["module", "gcc/11.3.0"].heading_path == ["Ice Lake"] and got["partition", "icelake"].heading_path == ["Ice Lake", "Jobs"]
    r = R.merged(C.registry_candidates(pages, "url", "text", "title"))
    assert r.entities.count() == 14 and r.entities.where("review_state <> 'auto_verified'").count() == 0
