"""Work mail, tagged by hand: word/TAG (Penn tags; # for punctuation, WH for question words, PRP$ and possessives as DT)."""

# The tagged sentences.
SENTENCES = """
Send/VB me/PRP the/DT numbers/NNS today/NN ./#
Please/UH review/VB the/DT attached/JJ draft/NN ./#
Call/VB me/PRP when/WH you/PRP get/VBP a/DT chance/NN ./#
He/PRP sends/VBZ the/DT update/NN every/DT Monday/NNP ./#
She/PRP reviews/VBZ all/DT contracts/NNS before/IN they/PRP are/VBP signed/VBN ./#
They/PRP need/VBP the/DT report/NN by/IN Friday/NNP ./#
I/PRP think/VBP we/PRP should/MD wait/VB ./#
We/PRP will/MD send/VB the/DT invoice/NN tomorrow/NN ./#
The/DT meeting/NN is/VBZ scheduled/VBN for/IN Tuesday/NNP ./#
The/DT meeting/NN was/VBD moved/VBN to/TO Thursday/NNP ./#
Can/MD you/PRP forward/VB this/DT to/TO John/NNP ?/#
Could/MD you/PRP please/UH check/VB the/DT figures/NNS ?/#
Do/VBP you/PRP have/VB the/DT latest/JJ version/NN ?/#
Did/VBD they/PRP sign/VB the/DT agreement/NN ?/#
Are/VBP we/PRP still/RB on/IN for/IN lunch/NN ?/#
Is/VBZ this/DT the/DT right/JJ file/NN ?/#
What/WH do/VBP you/PRP think/VB about/IN the/DT plan/NN ?/#
Where/WH is/VBZ the/DT contract/NN ?/#
When/WH will/MD the/DT deal/NN close/VB ?/#
Who/WH wrote/VBD this/DT memo/NN ?/#
Thanks/UH for/IN your/DT help/NN ./#
Thank/VBP you/PRP for/IN the/DT quick/JJ reply/NN ./#
Many/JJ thanks/NNS for/IN the/DT information/NN ./#
Thanks/UH in/IN advance/NN ./#
Sorry/UH for/IN the/DT delay/NN ./#
Sorry/UH to/TO bother/VB you/PRP again/RB ./#
Yes/UH ,/# that/DT works/VBZ for/IN me/PRP ./#
No/UH ,/# I/PRP have/VBP not/RB seen/VBN it/PRP ./#
Hello/UH everyone/NN ,/#
Hi/UH Sarah/NNP ,/#
Dear/JJ colleagues/NNS ,/#
Best/JJ regards/NNS ,/#
Let/VB me/PRP know/VB if/IN you/PRP have/VBP questions/NNS ./#
Let/VB 's/PRP meet/VB on/IN Wednesday/NNP ./#
Let/VB us/PRP discuss/VB this/DT soon/RB ./#
Make/VB sure/JJ the/DT team/NN has/VBZ access/NN ./#
Give/VB her/PRP the/DT keys/NNS ./#
Keep/VB me/PRP posted/VBN on/IN this/DT ./#
Take/VB a/DT look/NN at/IN page/NN 3/CD ./#
See/VB the/DT attached/JJ file/NN ./#
See/VB below/RB ./#
Note/VB that/IN the/DT office/NN is/VBZ closed/JJ on/IN Monday/NNP ./#
Do/VB not/RB reply/VB to/TO this/DT message/NN ./#
Do/VB n't/RB forget/VB the/DT deadline/NN ./#
Never/RB share/VB your/DT password/NN ./#
Please/UH do/VB not/RB forward/VB this/DT note/NN ./#
Please/UH let/VB us/PRP know/VB your/DT decision/NN ./#
Please/UH find/VB the/DT report/NN attached/VBN ./#
Kindly/RB confirm/VB receipt/NN of/IN this/DT letter/NN ./#
Just/RB use/VB the/DT old/JJ form/NN ./#
Then/RB save/VB the/DT file/NN and/CC close/VB the/DT window/NN ./#
If/IN you/PRP agree/VBP ,/# sign/VB both/DT copies/NNS ./#
If/IN not/RB ,/# call/VB the/DT help/NN desk/NN ./#
When/WH you/PRP arrive/VBP ,/# ask/VB for/IN Mark/NNP ./#
Once/IN it/PRP is/VBZ done/VBN ,/# tell/VB the/DT others/NNS ./#
John/NNP ,/# send/VB this/DT to/TO legal/JJ ./#
Mary/NNP ,/# please/UH book/VB a/DT room/NN for/IN ten/CD people/NNS ./#
Tom/NNP called/VBD this/DT morning/NN ./#
Anna/NNP asked/VBD about/IN the/DT budget/NN ./#
You/PRP must/MD finish/VB this/DT today/NN ./#
You/PRP have/VBP to/TO submit/VB the/DT form/NN ./#
You/PRP need/VBP to/TO update/VB your/DT profile/NN ./#
It/PRP needs/VBZ more/JJ work/NN ./#
It/PRP is/VBZ not/RB ready/JJ yet/RB ./#
This/DT is/VBZ a/DT good/JJ idea/NN ./#
This/DT looks/VBZ fine/JJ to/TO me/PRP ./#
That/DT sounds/VBZ great/JJ ./#
There/EX is/VBZ one/CD problem/NN ./#
There/EX are/VBP two/CD issues/NNS with/IN the/DT plan/NN ./#
I/PRP agree/VBP ./#
I/PRP have/VBP attached/VBN the/DT files/NNS ./#
I/PRP am/VBP writing/VBG to/TO confirm/VB our/DT call/NN ./#
I/PRP will/MD be/VB out/IN of/IN the/DT office/NN next/JJ week/NN ./#
I/PRP 'll/MD take/VB care/NN of/IN it/PRP ./#
I/PRP 'm/VBP not/RB sure/JJ this/DT is/VBZ right/JJ ./#
I/PRP was/VBD wondering/VBG if/IN we/PRP could/MD talk/VB ./#
I/PRP hope/VBP this/DT helps/VBZ ./#
I/PRP spoke/VBD with/IN the/DT client/NN yesterday/NN ./#
We/PRP discussed/VBD the/DT numbers/NNS ./#
We/PRP are/VBP waiting/VBG for/IN the/DT approval/NN ./#
We/PRP have/VBP received/VBN your/DT payment/NN ./#
We/PRP 'll/MD handle/VB the/DT rest/NN ./#
They/PRP want/VBP to/TO change/VB the/DT terms/NNS ./#
They/PRP signed/VBD the/DT contract/NN last/JJ week/NN ./#
The/DT weather/NN is/VBZ nice/JJ ./#
The/DT price/NN went/VBD up/RB again/RB ./#
The/DT team/NN works/VBZ on/IN a/DT new/JJ version/NN ./#
The/DT reports/NNS are/VBP due/JJ on/IN Friday/NNP ./#
The/DT call/NN went/VBD well/RB ./#
The/DT deadline/NN is/VBZ tomorrow/NN ./#
The/DT traders/NNS sold/VBD their/DT positions/NNS ./#
The/DT customer/NN wants/VBZ a/DT refund/NN ./#
Our/DT lawyers/NNS will/MD review/VB the/DT draft/NN ./#
Your/DT order/NN has/VBZ been/VBN shipped/VBN ./#
His/DT answer/NN was/VBD short/JJ ./#
My/DT notes/NNS from/IN the/DT call/NN are/VBP below/RB ./#
All/DT employees/NNS must/MD complete/VB the/DT training/NN ./#
Each/DT group/NN reports/VBZ to/TO a/DT manager/NN ./#
Some/DT people/NNS prefer/VBP email/NN ./#
Reports/NNS from/IN both/DT offices/NNS were/VBD late/JJ ./#
Prices/NNS are/VBP rising/VBG ./#
Changes/NNS to/TO the/DT schedule/NN follow/VBP ./#
Questions/NNS about/IN this/DT should/MD go/VB to/TO Linda/NNP ./#
Work/NN on/IN the/DT site/NN begins/VBZ in/IN May/NNP ./#
Sales/NNS fell/VBD by/IN 3/CD percent/NN ./#
Attached/VBN is/VBZ the/DT final/JJ version/NN ./#
Attached/VBN please/UH find/VB the/DT minutes/NNS ./#
Looking/VBG forward/RB to/TO your/DT reply/NN ./#
Sending/VBG this/DT again/RB ./#
Sent/VBN from/IN my/DT phone/NN ./#
Perhaps/RB we/PRP should/MD reconsider/VB ./#
Maybe/RB they/PRP forgot/VBD ./#
Unfortunately/RB ,/# the/DT flight/NN was/VBD cancelled/VBN ./#
However/RB ,/# we/PRP can/MD offer/VB a/DT discount/NN ./#
Also/RB ,/# the/DT printer/NN is/VBZ broken/JJ ./#
Would/MD you/PRP mind/VB sending/VBG this/DT over/RB ?/#
Would/MD it/PRP be/VB possible/JJ to/TO meet/VB earlier/RB ?/#
Why/WH did/VBD the/DT price/NN change/VB ?/#
How/WH much/JJ does/VBZ it/PRP cost/VB ?/#
Has/VBZ anyone/NN seen/VBN the/DT memo/NN ?/#
Fill/VB in/IN the/DT form/NN and/CC return/VB it/PRP ./#
Add/VB these/DT names/NNS to/TO the/DT list/NN ./#
Ask/VB the/DT vendor/NN for/IN a/DT quote/NN ./#
Bring/VB your/DT laptop/NN ./#
Check/VB the/DT spelling/NN ./#
Complete/VB the/DT survey/NN by/IN noon/NN ./#
Contact/VB the/DT help/NN desk/NN ./#
Fix/VB this/DT error/NN ./#
Get/VB back/RB to/TO me/PRP soon/RB ./#
Pay/VB the/DT bill/NN ./#
Prepare/VB a/DT summary/NN for/IN the/DT board/NN ./#
Provide/VB the/DT details/NNS ./#
Put/VB it/PRP on/IN my/DT desk/NN ./#
Read/VB the/DT instructions/NNS carefully/RB ./#
Remove/VB him/PRP from/IN the/DT list/NN ./#
Reply/VB to/TO all/DT ./#
Schedule/VB a/DT call/NN with/IN them/PRP ./#
Show/VB them/PRP the/DT results/NNS ./#
Start/VB with/IN the/DT first/JJ section/NN ./#
Stop/VB the/DT process/NN ./#
Update/VB the/DT file/NN ./#
Wait/VB for/IN my/DT signal/NN ./#
Write/VB a/DT short/JJ summary/NN ./#
Be/VB careful/JJ with/IN these/DT numbers/NNS ./#
Come/VB to/TO my/DT office/NN ./#
Feel/VB free/JJ to/TO call/VB ./#
Go/VB ahead/RB ./#
Plan/NN A/NN failed/VBD ./#
Good/JJ morning/NN ,/#
Great/JJ work/NN !/#
Nice/JJ to/TO meet/VB you/PRP ./#
Not/RB yet/RB ./#
Sure/JJ thing/NN ./#
See/VB you/PRP tomorrow/NN ./#
Talk/VB to/TO you/PRP later/RB ./#
Have/VB a/DT nice/JJ weekend/NN ./#
Have/VBP you/PRP seen/VBN this/DT ?/#
Had/VBD we/PRP known/VBN ,/# we/PRP would/MD have/VB waited/VBN ./#
It/PRP would/MD be/VB great/JJ if/IN you/PRP could/MD come/VB ./#
As/IN discussed/VBN ,/# the/DT fee/NN is/VBZ 500/CD dollars/NNS ./#
As/IN soon/RB as/IN possible/JJ ,/# send/VB us/PRP the/DT forms/NNS ./#
""".strip().splitlines()
