import pytest

from colsieve.__main__ import main

P = "/root/testdata/sf0.001/lineitem.parquet"


def test_scan_and_report(spark, capsys):
    main(["-p", P, "-w", "worst", "--column", "l_extendedprice", "--agg", "COUNT(l_extendedprice)"])
    assert "count_l_extendedprice" in capsys.readouterr().out
    main(["-p", P, "--where", "l_quantity < 0.0", "--report"])
    assert "lineitem.parquet" in capsys.readouterr().out
    main(["-p", P, "--where", "l_quantity > 49.0", "-cc", "2"])
    assert "l_partkey" in capsys.readouterr().out


@pytest.mark.parametrize("args", [["-p", P, "-w", "50"], ["-p", P, "-x"], []])
def test_wrong_flags_exit(spark, args):
    with pytest.raises(SystemExit):
        main(args)
