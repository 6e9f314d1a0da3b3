"""The channel dictionary: value range and unit per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Channel, lowest value, highest value, unit.  0 and 0 mean that no range is known.
_CHANNELS = """\
TruckForce_N,0,50000,N
TSteerAngle,-120,120,deg
TruckSpeed,-25,25,km/h
AxLoad,0,20000,kg
battery_temperature,-55,155,C°
SpeedMinBackw,0,25,km/h
SpeedMinForw,0,25,km/h
EConsum,0,50,kWh/h
Load,0,2000,kg
SpLim,0,0,
Key2State,0,0,
Key1State,0,0,
KeyEncState,0,0,
EncState,0,0,
WorkTimeToBeDisplayed,0,0,sec
TruckWorkTime,0,0,sec
TracDirLev,0,0,
PermHeight,0,0,mm
SpLimState,0,0,
TrBrk,0,0,
RemWorkTime,0,0,min
BatTemp,-50,120,C°
PowerSupply,0,0,
DaysToNextService,0,0,d
WorkTimeToNextService,0,0,min
L1_motTemp,0,120,C°
LiftTiltAng,0,8,deg
LiftHeight,0,25000,mm
LiftActive,0,0,
WeighProc,0,0,
T_motTemp_Lft,0,120,C°
T_BatCurr,0,1000,A
T_BatVolt,0,130,V
BatCharState,0,100,%
BrakeState,0,0,
T_TotalDischarge,0,0,
T_Seat,0,0,
BatVolt,0,131000,mV
FunctionKeyState,0,0,
ResetKeyState,0,0,
L1_estTorque,0,250,Nm
L1_measSpeed,0,4500,rpm
JoyAux4,0,0,
JoyAux3,0,0,
JoyAux2,0,0,
JoyTilt,0,0,
JoyAux1,0,0,
JoyLift,0,0,
DateTime,0,0,sec
LiIoBMS_BatteryVoltage,0,130,V
LiIoBMS_BatteryCurrent,0,1000,A
LiIonCharger_ChargingVoltV,0,130,V
LiIonCharger_ChargingCurrA,0,1000,A
LiIoBMS_SOCwithSOH,0,100,%
LiIoBMS_OutputVoltage,0,130,V
"""

SCHEMA = "channel STRING, min BIGINT, max BIGINT, unit STRING"


def channel_rows() -> list[tuple[str, int, int, str]]:
    rows = (line.split(",") for line in _CHANNELS.splitlines())
    return [(name, int(low), int(high), unit) for name, low, high, unit in rows]


def channel_table(spark: SparkSession) -> DataFrame:
    """The dictionary as a table.  Its size is fixed, so it is always safe to broadcast."""
    return spark.createDataFrame(channel_rows(), SCHEMA)
